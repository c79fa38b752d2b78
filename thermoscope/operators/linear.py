"""Linear models from distributed sufficient statistics.

Physical rule: every ridge fit, every CV fold and every alpha is answered from
one aggregate per ``(repeat, fold)`` bucket:

    n, Σx, Σy, XᵀX, Xᵀy, yᵀy        (x, y shifted by global means for stability)

Training statistics of fold f are ``total − bucket f``; the validation SSE of
any (w, b) follows from the bucket's own statistics.  So 15 folds × any number
of alphas cost one Spark job whose shuffle is one k×k buffer per bucket.  The
driver only solves k×k systems.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# ---------------------------------------------------------------- one feature

def ridge_1d(df: DataFrame, x: str, y: str, alpha: float) -> tuple[float, float]:
    """Closed-form ridge with an unpenalised intercept on one feature.

    slope = Sxy / (Sxx + α), intercept = ȳ − slope·x̄; Sxx, Sxy use Spark's
    numerically stable (co)variance aggregates.
    """
    return ridge_1d_many(df, x, y, [alpha])[0]


def ridge_1d_many(df: DataFrame, x: str, y: str, alphas) -> list[tuple[float, float]]:
    """:func:`ridge_1d` for several penalties from one aggregate (one data pass)."""
    row = df.agg(
        (F.covar_pop(x, y) * F.count(x)).alias("sxy"),
        (F.var_pop(x) * F.count(x)).alias("sxx"),
        F.avg(x).alias("mx"), F.avg(y).alias("my")).first()
    out = []
    for alpha in alphas:
        slope = row["sxy"] / (row["sxx"] + alpha)
        out.append((float(slope), float(row["my"] - slope * row["mx"])))
    return out


# ----------------------------------------------------------- gram statistics

def _shift_means(df: DataFrame, features: Sequence[str], y: str) -> dict[str, float]:
    row = df.agg(*[F.avg(c).alias(c) for c in [*features, y]]).first()
    return {c: float(row[c] or 0.0) for c in [*features, y]}


def gram_stats(df: DataFrame, features: Sequence[str], y: str, by: Sequence[str] = (),
               shift: dict[str, float] | None = None) -> DataFrame:
    """Per-group n, Σx, Σy, XᵀX (upper triangle), Xᵀy, yᵀy as built-in sums.

    Partial aggregation runs map-side, so the shuffle carries one small buffer
    per (partition, group).
    """
    shift = shift or {}
    xs = [(F.col(c) - F.lit(shift.get(c, 0.0))) for c in features]
    yy = F.col(y) - F.lit(shift.get(y, 0.0))
    k = len(features)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(yy).alias("sy"), F.sum(yy * yy).alias("syy")]
    aggs += [F.sum(xs[i]).alias(f"sx_{i}") for i in range(k)]
    aggs += [F.sum(xs[i] * yy).alias(f"sxy_{i}") for i in range(k)]
    aggs += [F.sum(xs[i] * xs[j]).alias(f"sxx_{i}_{j}") for i in range(k) for j in range(i, k)]
    return df.groupBy(*by).agg(*aggs)


@dataclass
class Suff:
    n: float
    sx: np.ndarray
    sy: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    def __sub__(self, o: "Suff") -> "Suff":
        return Suff(self.n - o.n, self.sx - o.sx, self.sy - o.sy, self.xx - o.xx,
                    self.xy - o.xy, self.yy - o.yy)

    def __add__(self, o: "Suff") -> "Suff":
        return Suff(self.n + o.n, self.sx + o.sx, self.sy + o.sy, self.xx + o.xx,
                    self.xy + o.xy, self.yy + o.yy)


def _suff_from_row(row, k: int) -> Suff:
    xx = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = row[f"sxx_{i}_{j}"]
    return Suff(float(row["n"]), np.array([row[f"sx_{i}"] for i in range(k)], float),
                float(row["sy"]), xx, np.array([row[f"sxy_{i}"] for i in range(k)], float),
                float(row["syy"]))


def solve_ridge(s: Suff, alpha: float, standardize: bool = False,
                scale: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Ridge (intercept unpenalised) from statistics: returns (w, b) in original units.

    ``standardize`` fits on (x − mean)/std of these rows; ``scale`` fits on
    (x − c)/scale for any per-feature scale (e.g. the fold's IQR for robust
    scaling) — the centre is absorbed by the intercept, so only the scale
    enters, as a per-feature penalty α·scale².
    """
    mu, nu = s.sx / s.n, s.sy / s.n
    c_xx = s.xx - s.n * np.outer(mu, mu)
    c_xy = s.xy - s.n * mu * nu
    k = len(mu)
    if standardize or scale is not None:
        sd = np.sqrt(np.clip(np.diag(c_xx) / s.n, 0.0, None)) if scale is None else np.array(scale, float)
        sd[sd == 0] = 1.0
        d = 1.0 / sd
        a = c_xx * np.outer(d, d) + alpha * np.eye(k)
        w = d * np.linalg.solve(a, d * c_xy)
    else:
        w = np.linalg.solve(c_xx + alpha * np.eye(k), c_xy)
    return w, float(nu - w @ mu)


def fold_train_iqr(folded: DataFrame, features: Sequence[str], key: str = "row_id",
                   repeat: str = "repeat", fold: str = "fold") -> dict[tuple, np.ndarray]:
    """Exact IQR of each feature over the *training* rows of every (repeat, fold).

    Each row joins the k−1 training sets it belongs to (an explode, not a
    join), then skew-safe exact quantiles run per (repeat, train fold, feature).
    """
    from .ranking import exact_quantiles
    folds = sorted(r[0] for r in folded.select(fold).distinct().collect())   # k values
    arr = F.array(*[F.lit(int(f)) for f in folds])
    t = folded.select(key, repeat, F.explode(F.filter(arr, lambda f: f != F.col(fold))).alias("__tf"),
                      F.inline(F.array(*[F.struct(F.lit(i).alias("__feat"), F.col(c).cast("double").alias("__v"))
                                         for i, c in enumerate(features)])))
    q = exact_quantiles(t, "__v", [0.25, 0.75], by=[repeat, "__tf", "__feat"], tiebreak=[key],
                        names=["q1", "q3"]).collect()   # (repeats × k × features) rows
    out: dict[tuple, np.ndarray] = {}
    for r in q:
        v = out.setdefault((r[repeat], r["__tf"]), np.ones(len(features)))
        v[r["__feat"]] = r["q3"] - r["q1"]
    return out


def sse_on(s: Suff, w: np.ndarray, b: float) -> float:
    return float(s.yy - 2 * w @ s.xy - 2 * b * s.sy + w @ s.xx @ w
                 + 2 * b * (w @ s.sx) + s.n * b * b)


def r2_on(s: Suff, w: np.ndarray, b: float) -> float:
    sst = s.yy - s.sy * s.sy / s.n
    sse = sse_on(s, w, b)
    if sst > 0:
        return 1.0 - sse / sst
    return 1.0 if sse == 0 else 0.0


def bucket_stats(df: DataFrame, features: Sequence[str], y: str,
                 by: Sequence[str]) -> dict[tuple, Suff]:
    """Collect the (bounded: buckets × k²) statistics table to the driver."""
    shift = _shift_means(df, features, y)
    rows = gram_stats(df, features, y, by, shift).collect()
    return {tuple(r[c] for c in by): _suff_from_row(r, len(features)) for r in rows}


def cv_ridge_scores(spark: SparkSession, folded: DataFrame, features: Sequence[str], y: str,
                    alphas: Sequence[float], standardize: bool = False,
                    repeat: str = "repeat", fold: str = "fold") -> DataFrame:
    """R² of every (repeat, fold, alpha) from one aggregation job.

    ``folded`` has one row per (row, repeat) with a ``fold`` column, as built by
    :func:`thermoscope.operators.split.folds`.
    """
    stats = bucket_stats(folded, features, y, [repeat, fold])
    repeats = sorted({r for r, _ in stats})
    out = []
    for r in repeats:
        buckets = {f: s for (rr, f), s in stats.items() if rr == r}
        total = None
        for s in buckets.values():
            total = s if total is None else total + s
        for f, s in sorted(buckets.items()):
            train = total - s
            for a in alphas:
                w, b = solve_ridge(train, a, standardize)
                out.append((int(r), int(f), float(a), float(r2_on(s, w, b))))
    schema = T.StructType([T.StructField("repeat", T.IntegerType()),
                           T.StructField("fold", T.IntegerType()),
                           T.StructField("alpha", T.DoubleType()),
                           T.StructField("r2", T.DoubleType())])
    return spark.createDataFrame(out, schema)


def noise_ceiling(scores: DataFrame, floor: float | None = None) -> DataFrame:
    """Mean + 2·std_pop of fold R² (optionally floored); baseline = mean."""
    ceiling = F.avg("r2") + 2 * F.stddev_pop("r2")
    if floor is not None:
        ceiling = F.greatest(ceiling, F.lit(float(floor)))
    return scores.groupBy("alpha").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_folds"),
        F.round(F.avg("r2"), 6).alias("baseline_r2"),
        F.round(F.stddev_pop("r2"), 6).alias("std_r2"),
        F.round(ceiling, 6).alias("noise_ceiling"))


# ------------------------------------------------------------------ fitting

def fit_ridge(df: DataFrame, features: Sequence[str], y: str, alpha: float,
              standardize: bool = False) -> tuple[np.ndarray, float]:
    """Ridge on all rows of ``df``; coefficients in the original units."""
    shift = _shift_means(df, features, y)
    row = gram_stats(df, features, y, (), shift).first()
    s = _suff_from_row(row, len(features))
    w, b = solve_ridge(s, alpha, standardize)
    mx = np.array([shift[c] for c in features])
    return w, float(b + shift[y] - w @ mx)


def linear_predict(features: Sequence[str], w: Sequence[float], b: float) -> Column:
    expr = F.lit(float(b))
    for c, wi in zip(features, w):
        expr = expr + F.col(c) * F.lit(float(wi))
    return expr


# ------------------------------------------------------- leave-one-out ridge

def ridge_loo(df: DataFrame, features: Sequence[str], y: str,
              alphas: Sequence[float], digits: int = 6) -> DataFrame:
    """Leave-one-out MSE for every alpha with one extra data pass.

    With C = VΛVᵀ (centred Gram), each row's hat value and residual for all
    alphas follow from z = Vᵀ(x − μ):  h = 1/n + Σ z²/(λ+α),
    r = (y − ȳ) − Σ z·(Vᵀc)/(λ+α).  Executors receive V, λ, Vᵀc (k² + 2k
    numbers) and return one partial sum per alpha per partition.
    """
    spark = df.sparkSession
    shift = _shift_means(df, features, y)
    s = _suff_from_row(gram_stats(df, features, y, (), shift).first(), len(features))
    mu, nu = s.sx / s.n, s.sy / s.n
    c_xx = s.xx - s.n * np.outer(mu, mu)
    c_xy = s.xy - s.n * mu * nu
    lam, vec = np.linalg.eigh(c_xx)
    proj = vec.T @ c_xy
    al = np.asarray(alphas, float)
    consts = spark.sparkContext.broadcast(
        (vec, lam, proj, al, mu, nu, s.n, [shift[c] for c in features], shift[y]))
    feats = list(features)

    def part(batches):
        import pandas as pd
        v, lm, pj, a, m, yn, n, fx, fy = consts.value
        acc = np.zeros(len(a))
        cnt = 0
        for pdf in batches:
            x = pdf[feats].to_numpy(float) - np.asarray(fx) - m
            yc = pdf[y].to_numpy(float) - fy - yn
            z = x @ v
            inv = 1.0 / (lm[None, :] + a[:, None])            # (A, k)
            h = 1.0 / n + (z * z) @ inv.T                       # (rows, A)
            r = yc[:, None] - z @ (inv * pj[None, :]).T         # (rows, A)
            acc += np.sum((r / (1.0 - h)) ** 2, axis=0)
            cnt += len(pdf)
        yield pd.DataFrame({"alpha": a, "sse": acc, "n": np.full(len(a), cnt, dtype="int64")})

    partial = df.select(*feats, y).mapInPandas(part, "alpha double, sse double, n long")
    return partial.groupBy("alpha").agg(
        F.round(F.sum("sse") / F.sum("n"), digits).alias("loo_mse"))


# -------------------------------------------------- lasso and elastic net

def elastic_net(df: DataFrame, features: Sequence[str], y: str, alpha: float,
                l1_ratio: float, max_iter: int = 2000):
    """M25/M26 on MLlib's distributed L-BFGS/OWL-QN.

    The reference's penalty ``α·ρ·|w|₁ + α(1−ρ)/2·|w|²`` on a ``1/(2n)`` loss
    maps to MLlib (which scales the L2 part by the label's sample std when
    ``standardization=False``) as regParam = A + B, elasticNetParam = A/(A+B)
    with A = αρ, B = α(1−ρ)·sd(y).
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    sd = float(df.agg(F.stddev_samp(y)).first()[0] or 1.0)
    a_part = alpha * l1_ratio
    b_part = alpha * (1.0 - l1_ratio) * sd
    reg = a_part + b_part
    enet = a_part / reg if reg > 0 else 0.0
    vec = VectorAssembler(inputCols=list(features), outputCol="__features").transform(df)
    lr = LinearRegression(featuresCol="__features", labelCol=y, regParam=reg,
                          elasticNetParam=enet, standardization=False, maxIter=max_iter,
                          tol=1e-10, solver="l-bfgs" if enet < 1.0 else "auto")
    return lr.fit(vec)


def lasso(df: DataFrame, features: Sequence[str], y: str, alpha: float, max_iter: int = 2000):
    """Pure L1 (regParam = α, elasticNetParam = 1)."""
    return elastic_net(df, features, y, alpha, 1.0, max_iter)
