"""Decompositions and feature elimination from one distributed Gram pass.

Executors emit one partial (n, Σx, XᵀX[, Σy, Xᵀy, yᵀy]) per (partition,
group); the partials — at most one per partition — are summed per group and
the driver solves d×d problems (d ≤ a few thousand after width reduction).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linear import Suff, r2_on


SHIFT_ROWS = 64   # rows whose mean serves as the origin of the sums


def origin(df: DataFrame, features: str, y: str | None = None) -> tuple[np.ndarray, float]:
    """A point near the data: sums taken from it do not cancel when values lie far from zero.

    Any point gives the same results in exact arithmetic, so a few rows are enough.
    """
    rows = df.select(features, *([y] if y else [])).limit(SHIFT_ROWS).collect()
    if not rows:
        return np.zeros(0), 0.0
    return (np.mean([np.asarray(r[0], float) for r in rows], axis=0),
            float(np.mean([r[1] for r in rows])) if y else 0.0)


def vector_suff(df: DataFrame, features: str, y: str | None = None, by: Sequence[str] = (),
                shift: tuple[np.ndarray, float] | None = None) -> dict[tuple, Suff]:
    """Sufficient statistics of an array column per group (y optional), of values minus ``shift``."""
    by = list(by)
    x0, y0 = shift if shift is not None else (0.0, 0.0)

    def partial(batches):
        acc: dict[tuple, list] = {}
        for pdf in batches:
            groups = pdf.groupby(by, sort=False) if by else [((), pdf)]
            for key, g in groups:
                key = key if isinstance(key, tuple) else (key,)
                x = np.stack(g[features].to_numpy()).astype(float) - x0
                t = g[y].to_numpy(float) - y0 if y else np.zeros(len(g))
                a = acc.get(key)
                if a is None:
                    d = x.shape[1]
                    a = acc[key] = [0, np.zeros(d), 0.0, np.zeros((d, d)), np.zeros(d), 0.0]
                a[0] += len(x)
                a[1] += x.sum(0)
                a[2] += t.sum()
                a[3] += x.T @ x
                a[4] += x.T @ t
                a[5] += t @ t
        for key, a in acc.items():
            row = {f"g{i}": [v] for i, v in enumerate(key)}
            row.update({"n": [a[0]], "sx": [a[1]], "sy": [a[2]], "xx": [a[3].ravel()], "xy": [a[4]],
                        "yy": [a[5]]})
            yield pd.DataFrame(row)

    gschema = ", ".join(f"g{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(by))
    schema = (gschema + ", " if gschema else "") + \
        "n long, sx array<double>, sy double, xx array<double>, xy array<double>, yy double"
    cols = [*by, features] + ([y] if y else [])
    parts = df.select(*cols).mapInPandas(partial, schema)
    # one partial per (input partition, group); sum them on executors in
    # ≈√partitions buckets so neither one task nor the driver sees them all
    n_parts = max(1, df.rdd.getNumPartitions())
    buckets = max(1, int(np.ceil(np.sqrt(n_parts))))
    gcols = [f"g{i}" for i in range(len(by))]

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        row = {c: [first[c]] for c in gcols}
        row.update({"n": [int(pdf["n"].sum())], "sx": [np.sum(np.stack(pdf["sx"].to_numpy()), 0)],
                    "sy": [float(pdf["sy"].sum())], "xx": [np.sum(np.stack(pdf["xx"].to_numpy()), 0)],
                    "xy": [np.sum(np.stack(pdf["xy"].to_numpy()), 0)], "yy": [float(pdf["yy"].sum())]})
        return pd.DataFrame(row)

    parts = parts.withColumn("__b", F.spark_partition_id() % buckets)
    level1 = parts.groupBy(*gcols, "__b").applyInPandas(reduce, schema)      # ≤ √P partials per group
    reduced = level1.groupBy(*gcols).applyInPandas(reduce, schema) if gcols else \
        level1.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(reduce, schema)
    rows = reduced.collect()  # exactly one d² block per group
    out: dict[tuple, Suff] = {}
    for r in rows:
        key = tuple(r[f"g{i}"] for i in range(len(by)))
        d = len(r["sx"])
        s = Suff(float(r["n"]), np.array(r["sx"]), float(r["sy"]), np.array(r["xx"]).reshape(d, d),
                 np.array(r["xy"]), float(r["yy"]))
        out[key] = s if key not in out else out[key] + s
    return out


def pca_fit(df: DataFrame, features: str, k: int | float) -> dict:
    """Centred covariance eigen-decomposition; ``k`` int or variance fraction."""
    shift = origin(df, features)
    s = vector_suff(df, features, shift=shift)[()]
    mu = s.sx / s.n
    cov = (s.xx - s.n * np.outer(mu, mu)) / (s.n - 1)
    mu = mu + shift[0]
    lam, vec = np.linalg.eigh(cov)
    order = np.argsort(lam)[::-1]
    lam, vec = np.clip(lam[order], 0.0, None), vec[:, order]
    ratio = lam / lam.sum() if lam.sum() > 0 else lam
    if isinstance(k, float) and 0 < k < 1:
        k = int(np.searchsorted(np.cumsum(ratio), k, side="right") + 1)
    k = int(min(k, len(lam)))
    # sign convention: largest |loading| positive
    for j in range(k):
        if vec[np.argmax(np.abs(vec[:, j])), j] < 0:
            vec[:, j] = -vec[:, j]
    return {"mean": mu, "components": vec[:, :k], "explained_variance": lam[:k],
            "ratio": ratio[:k], "k": k}


def pca_table(fit: dict, spark) -> DataFrame:
    rows = [(int(i), float(v), float(r), float(c)) for i, (v, r, c) in
            enumerate(zip(fit["explained_variance"], fit["ratio"], np.cumsum(fit["ratio"])))]
    schema = T.StructType([T.StructField("component", T.IntegerType()),
                           T.StructField("explained_variance", T.DoubleType()),
                           T.StructField("ratio", T.DoubleType()), T.StructField("cumulative", T.DoubleType())])
    return spark.createDataFrame(rows, schema)


def project(df: DataFrame, features: str, fit: dict, out: str = "components",
            center: bool = True) -> DataFrame:
    """Apply a fitted projection with the d×k matrix broadcast."""
    bc = df.sparkSession.sparkContext.broadcast((fit["mean"] if center else None, fit["components"]))

    @F.pandas_udf("array<double>")
    def proj(col: pd.Series) -> pd.Series:
        mu, w = bc.value
        x = np.stack(col.to_numpy()).astype(float)
        if mu is not None:
            x = x - mu
        return pd.Series(list(x @ w))

    return df.withColumn(out, proj(F.col(features)))


def svd_fit(df: DataFrame, features: str, k: int) -> dict:
    """Truncated SVD (no centring) from the uncentred Gram XᵀX."""
    s = vector_suff(df, features)[()]
    lam, vec = np.linalg.eigh(s.xx)
    order = np.argsort(lam)[::-1][:k]
    sing = np.sqrt(np.clip(lam[order], 0.0, None))
    return {"singular_values": sing, "components": vec[:, order], "mean": None}


def kernel_pca(df: DataFrame, features: str, k: int, gamma: float = 1.0, n_features: int = 256,
               seed: int = 42) -> tuple[DataFrame, dict]:
    """M13 (declared approximation): RBF kernel PCA via random Fourier features + PCA."""
    from .kernel import random_fourier_features
    z = random_fourier_features(df, features, gamma, n_features, seed, out="__rff")
    fit = pca_fit(z, "__rff", k)
    return project(z, "__rff", fit).drop("__rff"), fit


REFRESH = 64   # removals after which the inverse is computed anew


def _scaled(train: Suff, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(penalised matrix, right side, scale) of ridge on standardised features."""
    mu, nu = train.sx / train.n, train.sy / train.n
    xx = train.xx - train.n * np.outer(mu, mu)
    sd = np.sqrt(np.clip(np.diag(xx) / train.n, 0.0, None))
    sd = np.where(sd == 0, 1.0, sd)
    return xx / np.outer(sd, sd) + alpha * np.eye(len(mu)), (train.xy - train.n * mu * nu) / sd, sd


class _Shrinking:
    """Weights of ridge while features leave one by one: each removal updates the inverse by one pivot."""

    def __init__(self, a: np.ndarray, c: np.ndarray):
        self.a, self.c, self.active, self.since = a, c, np.arange(len(c)), 0
        self._invert()

    def _invert(self) -> None:
        self.inverse = np.linalg.inv(self.a[np.ix_(self.active, self.active)])
        self.weights = self.inverse @ self.c[self.active]
        self.since = 0

    def remove(self, feature: int) -> None:
        j = int(np.searchsorted(self.active, feature))
        column, pivot = self.inverse[:, j], self.inverse[j, j]
        w = self.weights - column * (self.weights[j] / pivot)
        inverse = self.inverse - np.outer(column, column / pivot)
        self.inverse, self.weights = np.delete(np.delete(inverse, j, 0), j, 1), np.delete(w, j)
        self.active = np.delete(self.active, j)
        self.since += 1
        if self.since >= REFRESH:
            self._invert()

    def weakest(self) -> int:
        return int(self.active[np.argmin(np.abs(self.weights))])


def _elimination_order(total: Suff, alpha: float, min_features: int) -> list[int]:
    a, c, _ = _scaled(total, alpha)
    left, order = _Shrinking(a, c), []
    while len(left.active) > min_features:
        order.append(left.weakest())
        left.remove(order[-1])
    return order


def _fold_scores(train: Suff, bucket: Suff, alpha: float, order: list[int]) -> list[float]:
    """R2 of the held-out rows before the first removal and after each one."""
    a, c, sd = _scaled(train, alpha)
    left, out = _Shrinking(a, c), []
    for feature in [None, *order]:
        if feature is not None:
            left.remove(feature)
        i = left.active
        w = left.weights / sd[i]
        b = float(train.sy / train.n - w @ (train.sx[i] / train.n))
        out.append(r2_on(Suff(bucket.n, bucket.sx[i], bucket.sy, bucket.xx[np.ix_(i, i)], bucket.xy[i], bucket.yy), w, b))
    return out


def rfe_cv(folded: DataFrame, features: str, y: str, alpha: float = 1.0,
           min_features: int = 1) -> pd.DataFrame:
    """Recursive elimination by smallest |standardised ridge weight|, each subset scored by CV.

    One data pass for the sums of every fold.  The order of elimination follows from the sums of all rows; every (repeat, fold) is
    then a Spark task that removes one feature a step, d^3 operations in all.  The driver keeps sums and scores.
    """
    spark = folded.sparkSession
    stats = vector_suff(folded, features, y, ["repeat", "fold"], shift=origin(folded, features, y))
    reps = sorted({k[0] for k in stats})
    whole: dict = {}
    for (r, _), s in stats.items():
        whole[r] = s if r not in whole else whole[r] + s
    total = whole[reps[0]]   # every row once: the buckets of the first repeat
    d = len(total.sx)
    bc = spark.sparkContext.broadcast((stats, whole, total))   # folds x d x d numbers
    keys = sorted(stats)

    def order_task(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"dropped": [_elimination_order(bc.value[2], alpha, min_features)]})

    one = spark.createDataFrame([(0,)], "k int").coalesce(1)
    order = [int(i) for i in one.mapInPandas(order_task, "dropped array<int>").first()["dropped"]]

    def score_task(batches):
        sums, by_rep, _ = bc.value
        for pdf in batches:
            for k in pdf["k"]:
                r, f = keys[int(k)]
                scores = _fold_scores(by_rep[r] - sums[r, f], sums[r, f], alpha, order)
                yield pd.DataFrame({"step": range(len(scores)), "r2": scores})

    tasks = spark.createDataFrame([(i,) for i in range(len(keys))], "k int").repartition(len(keys))
    scored = tasks.mapInPandas(score_task, "step int, r2 double").groupBy("step").agg(F.avg("r2").alias("r2")).collect()
    mean = {r["step"]: r["r2"] for r in scored}
    active, rows = list(range(d)), []
    for step in range(len(order) + 1):
        if step:
            active = [f for f in active if f != order[step - 1]]
        rows.append((len(active), float(mean[step]), list(active)))
    out = pd.DataFrame(rows, columns=["n_features", "cv_r2", "features"])
    best = out.sort_values(["cv_r2", "n_features"], ascending=[False, True]).iloc[0]["n_features"]
    out["chosen"] = out["n_features"] == best
    return out
