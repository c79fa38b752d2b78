"""Trials on an array column that apply what they draw, and the refit of the best one.

* **Selection inside folds.**  Per (repeat, fold) sums n, x, y, xx, xy, yy come from one pass.  The sums of a
  training set are ``total - bucket``; the F score of every feature follows from them, so
  a trial's ``k_features`` best columns pick a part of the training matrix.  No fold is read again for any
  number of trials.
* **ridge_cv** chooses its penalty inside each training set by leave-one-out errors: one
  further pass for all folds, scalers and penalties.
* **Refit.**  The parameters of the best saved trial are rebuilt as selection, scaler and model, and
  fitted to all training rows; the model saves and loads as one folder.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decompose import origin, vector_suff
from .linear import Suff, r2_on, solve_ridge

WIDE = 500                                    # fixed value: selection applies beyond this width
RIDGE_CV_ALPHAS = np.logspace(-3, 2, 50)      # fixed values: the reference's penalties
LINEAR = ("ridge", "ridge_cv", "lasso", "elastic")


def take(s: Suff, idx: np.ndarray) -> Suff:
    """The sums of some features only."""
    return Suff(s.n, s.sx[idx], s.sy, s.xx[np.ix_(idx, idx)], s.xy[idx], s.yy)


def f_of(s: Suff) -> np.ndarray:
    """Univariate F of every feature from sums; 0 without variance, infinite for a perfect line."""
    c_xy = s.xy - s.sx * s.sy / s.n
    c_xx = np.diag(s.xx) - s.sx ** 2 / s.n
    c_yy = s.yy - s.sy ** 2 / s.n
    flat = (c_xx <= 1e-12 * np.abs(np.diag(s.xx))) | (c_yy <= 0)
    r2 = np.where(flat, 0.0, c_xy ** 2 / np.where(flat, 1.0, c_xx * c_yy))
    with np.errstate(divide="ignore"):
        return np.where(r2 >= 1, np.inf, r2 / (1 - np.minimum(r2, 1)) * (s.n - 2))


def best_features(s: Suff, k: int | None) -> np.ndarray:
    """The ``k`` features of greatest F, in column order; ties go to the smaller column.  None keeps all."""
    if not k or k >= len(s.sx):
        return np.arange(len(s.sx))
    return np.sort(np.argsort(-f_of(s), kind="stable")[:k])


def drawn_k(params: dict, width: int, wide: int = WIDE) -> int | None:
    """The number of features a trial keeps, if its selection is on and the table is wide."""
    if params.get("use_feature_selection") != "True" or width <= wide or "k_features" not in params:
        return None
    return int(float(params["k_features"]))


def _std(s: Suff) -> np.ndarray:
    sd = np.sqrt(np.clip(np.diag(s.xx) / s.n - (s.sx / s.n) ** 2, 0.0, None))
    return np.where(sd == 0, 1.0, sd)


def train_iqr(folded: DataFrame, features: str, width: int) -> dict[tuple, np.ndarray]:
    """Exact IQR of every feature over the training rows of each (repeat, fold); a zero becomes 1."""
    from .ranking import exact_quantiles
    folds = sorted(r[0] for r in folded.select("fold").distinct().collect())
    others = F.array(*[F.lit(int(f)) for f in folds])
    long = folded.select("repeat", F.explode(F.filter(others, lambda f: f != F.col("fold"))).alias("left_out"),
                         F.posexplode(features).alias("f", "v"))
    out: dict[tuple, np.ndarray] = {}
    for r in exact_quantiles(long, "v", [0.25, 0.75], by=["repeat", "left_out", "f"], names=["a", "b"]).collect():
        v = out.setdefault((r["repeat"], r["left_out"]), np.ones(width))   # repeats x folds x width numbers
        v[r["f"]] = (r["b"] - r["a"]) or 1.0
    return out


@dataclass
class FoldSums:
    """Sums of every fold of an array column about one origin."""
    buckets: dict[tuple, Suff]
    shift: tuple[np.ndarray, float]
    width: int

    def train(self, repeat, fold) -> Suff:
        whole = None
        for (r, f), s in self.buckets.items():
            if r == repeat and f != fold:
                whole = s if whole is None else whole + s
        return whole


def fold_sums(folded: DataFrame, features: str, y: str) -> FoldSums:
    shift = origin(folded, features, y)
    return FoldSums(vector_suff(folded, features, y, ["repeat", "fold"], shift=shift), shift, len(shift[0]))


def _scale(kind: str, train: Suff, iqr: np.ndarray | None) -> np.ndarray:
    if kind == "robust":
        return iqr
    return _std(train) if kind == "standard" else np.ones(len(train.sx))


def _trial_rows(trials: DataFrame) -> list[tuple[int, str, dict]]:
    rows = trials.select("trial", F.col("params")).collect()   # bounded by the trial budget
    return [(int(r["trial"]), r["params"].get("model_type", "ridge"), dict(r["params"])) for r in rows]


def _setup(p: dict, sums: FoldSums, key: tuple, iqr: dict, wide: int):
    """(kept columns, scale of the kept columns, their training sums) of a trial in one fold."""
    train = sums.train(*key)
    idx = best_features(train, drawn_k(p, sums.width, wide))
    return idx, _scale(p.get("scaler_type", "none"), train, iqr.get(key))[idx], take(train, idx)


def array_trial_scores(spark: SparkSession, folded: DataFrame, features: str, y: str, trials: DataFrame,
                       wide: int = WIDE) -> DataFrame:
    """``trial, repeat, fold, n_features, alpha, r2`` of ridge and ridge_cv trials, everything fitted inside each fold."""
    sums, found = fold_sums(folded, features, y), _trial_rows(trials)
    robust = any(p.get("scaler_type") == "robust" for _, _, p in found)
    iqr = train_iqr(folded, features, sums.width) if robust else {}
    chosen = _ridge_cv_alphas(folded, features, y, [p for _, kind, p in found if kind == "ridge_cv"], sums, iqr, wide)
    out = []
    for key, bucket in sorted(sums.buckets.items()):
        for t, kind, p in found:
            idx, scale, train = _setup(p, sums, key, iqr, wide)
            alpha = chosen[key, _choice(p, sums.width, wide)] if kind == "ridge_cv" else float(p["ridge_alpha"])
            w, b = solve_ridge(train, alpha, scale=scale)
            out.append((t, int(key[0]), int(key[1]), len(idx), float(alpha), float(r2_on(take(bucket, idx), w, b))))
    return spark.createDataFrame(out, "trial int, repeat int, fold int, n_features int, alpha double, r2 double")


def _choice(p: dict, width: int, wide: int) -> tuple:
    return p.get("scaler_type", "none"), drawn_k(p, width, wide)


def _ridge_cv_alphas(rows: DataFrame, features: str, y: str, params: list[dict], sums: FoldSums, iqr: dict, wide: int) -> dict:
    """The penalty of smallest leave-one-out error, by (fold key, (scaler, k)): one pass over the rows for all of them.

    A fold key stands for the rows outside it.
    """
    if not params:
        return {}
    by_choice = {_choice(p, sums.width, wide): p for p in params}
    jobs = []
    for key in sorted(sums.buckets):
        for choice, p in by_choice.items():
            idx, scale, train = _setup(p, sums, key, iqr, wide)
            mu, nu = train.sx / train.n, train.sy / train.n
            d = 1.0 / scale
            xx = (train.xx - train.n * np.outer(mu, mu)) * np.outer(d, d)
            lam, vec = np.linalg.eigh(xx)
            proj = vec.T @ (d * (train.xy - train.n * mu * nu))
            jobs.append((key, choice, idx, mu, nu, train.n, vec * d[:, None], np.clip(lam, 0, None), proj))
    bc = rows.sparkSession.sparkContext.broadcast((jobs, sums.shift))
    alphas = RIDGE_CV_ALPHAS

    def part(batches):
        todo, (x0, y0) = bc.value
        sse = np.zeros((len(todo), len(alphas)))
        for pdf in batches:
            if not len(pdf):
                continue
            x, t = np.stack(pdf[features].to_numpy()).astype(float) - x0, pdf[y].to_numpy(float) - y0
            rep, fold = pdf["repeat"].to_numpy(), pdf["fold"].to_numpy()
            for j, (key, _, idx, mu, nu, n, vec, lam, proj) in enumerate(todo):
                mine = (rep == key[0]) & (fold != key[1])
                z = (x[mine][:, idx] - mu) @ vec
                inv = 1.0 / (lam[None, :] + alphas[:, None])
                h = 1.0 / n + (z * z) @ inv.T
                r = (t[mine] - nu)[:, None] - z @ (inv * proj).T
                sse[j] += ((r / (1.0 - h)) ** 2).sum(0)
        j, a = np.indices(sse.shape)
        yield pd.DataFrame({"job": j.ravel(), "a": a.ravel(), "sse": sse.ravel()})

    errors = rows.select("repeat", "fold", features, y).mapInPandas(part, "job int, a int, sse double") \
        .groupBy("job", "a").agg(F.sum("sse").alias("sse"))
    best = errors.groupBy("job").agg(F.min(F.struct("sse", "a")).alias("m")).collect()   # one row per job
    return {(jobs[r["job"]][0], jobs[r["job"]][1]): float(alphas[r["m"]["a"]]) for r in best}


# ------------------------------------------------------------------------ refit

@dataclass
class TrialModel:
    """A fitted trial: kept columns, scaler and model of an array column."""
    params: dict
    kept: list[int]
    center: list[float]
    scale: list[float]
    kind: str                       # linear | trees | median | kernel
    state: dict = field(default_factory=dict)
    nodes: pd.DataFrame | None = None

    def transform(self, df: DataFrame, features: str = "features", out: str = "prediction") -> DataFrame:
        """Every row with its prediction; the model is broadcast."""
        from .trees import prepare_trees
        spark = df.sparkSession
        trees = prepare_trees(spark.createDataFrame(self.nodes)).value if self.nodes is not None else None
        bc = spark.sparkContext.broadcast((np.array(self.kept), np.array(self.center), np.array(self.scale), self.state, trees))
        kind = self.kind

        @F.pandas_udf("double")
        def score(col: pd.Series) -> pd.Series:
            idx, center, scale, state, ts = bc.value
            if not len(col):
                return pd.Series([], dtype=float)
            x = (np.stack(col.to_numpy()).astype(float)[:, idx] - center) / scale
            if kind == "linear":
                return pd.Series(x @ np.array(state["w"]) + state["b"])
            if kind == "kernel":
                z = np.sqrt(2.0 / len(state["phase"])) * np.cos(x @ np.array(state["omega"]) + np.array(state["phase"]))
                return pd.Series((z @ np.array(state["w"]) + state["b"]) * state["sd"] + state["mu"])
            each = np.column_stack([_leaf_values(x, t) for t in ts])
            w = np.array([t[5] for t in ts])
            if kind == "trees":
                return pd.Series(each @ w)
            order = np.argsort(each, axis=1)
            reached = np.cumsum(w[order], axis=1)
            at = (reached >= 0.5 * reached[:, -1:]).argmax(axis=1)
            rows = np.arange(len(each))
            return pd.Series(each[rows, order[rows, at]])

        return df.withColumn(out, score(F.col(features).cast("array<double>")))

    def save(self, spark: SparkSession, path: str) -> None:
        body = {k: getattr(self, k) for k in ("params", "kept", "center", "scale", "kind", "state")}
        spark.createDataFrame([(json.dumps(body),)], "body string").write.mode("overwrite").parquet(f"{path}/model")
        if self.nodes is not None:
            spark.createDataFrame(self.nodes).write.mode("overwrite").parquet(f"{path}/nodes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TrialModel":
        body = json.loads(spark.read.parquet(f"{path}/model").first()["body"])
        nodes = spark.read.parquet(f"{path}/nodes").toPandas() if body["kind"] in ("trees", "median") else None
        return TrialModel(**body, nodes=nodes)


def _leaf_values(x: np.ndarray, tree) -> np.ndarray:
    feature, threshold, left, right, value, _ = tree
    node, rows = np.zeros(len(x), int), np.arange(len(x))
    while len(rows):
        rows = rows[feature[node[rows]] >= 0]
        at = node[rows]
        node[rows] = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
    return value[node]


def _center_scale(train: DataFrame, features: str, kind: str, s: Suff, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if kind != "robust":
        return s.sx / s.n + shift, _scale(kind, s, None)
    from .ranking import exact_quantiles
    long = train.select(F.posexplode(features).alias("f", "v"))
    center, scale = np.zeros(len(s.sx)), np.ones(len(s.sx))
    for r in exact_quantiles(long, "v", [0.25, 0.5, 0.75], by=["f"], names=["a", "m", "b"]).collect():   # one per feature
        center[r["f"]], scale[r["f"]] = r["m"], (r["b"] - r["a"]) or 1.0
    return center, scale


def fit_trial(train: DataFrame, features: str, y: str, params: dict, wide: int = WIDE, key: str = "row_id") -> TrialModel:
    """Selection, scaler and model of a trial's parameters, fitted to all rows of ``train``."""
    from ..session import ensure_checkpoint_dir, materialize
    spark, kind = train.sparkSession, params["model_type"]
    train = train.select(key, F.col(features).cast("array<double>").alias(features), F.col(y).cast("double").alias(y))
    shift = origin(train, features, y)
    s = vector_suff(train, features, y, shift=shift)[()]
    idx = best_features(s, drawn_k(params, len(s.sx), wide))
    center, scale = _center_scale(train, features, params.get("scaler_type", "none"), s, shift[0])
    model = TrialModel(params, [int(i) for i in idx], [float(v) for v in center[idx]], [float(v) for v in scale[idx]], "linear")
    g = lambda name, default=None: float(params.get(f"{kind}_{name}", default))
    if kind in ("ridge", "ridge_cv"):
        if kind == "ridge":
            alpha = g("alpha")
        else:   # all rows are one training set: those outside a fold that no row is in
            whole = FoldSums({(0, 0): s, (0, -1): s}, shift, len(s.sx))
            iqr = {(0, -1): scale, (0, 0): scale}
            alpha = _ridge_cv_alphas(train.withColumn("repeat", F.lit(0)).withColumn("fold", F.lit(0)), features, y, [params],
                                     whole, iqr, wide)[(0, -1), _choice(params, len(s.sx), wide)]
        w, b = solve_ridge(take(s, idx), alpha, scale=scale[idx])
        w = np.atleast_1d(w)
        # from original units about the origin of the sums to scaled units about the centre
        model.state = {"w": [float(v) for v in w * scale[idx]], "alpha": float(alpha),
                       "b": float(b + shift[1] + w @ (center[idx] - shift[0][idx]))}
        return model
    from . import ensembles as en
    from . import linear as lin
    from . import trees as tr
    from .boosting import fit_boosting
    pick, c, d = (F.lit(np.array(v)) for v in (idx.astype(np.int32) + 1, center[idx], scale[idx]))
    chosen = F.transform(pick, lambda i: F.element_at(F.col(features), i))
    scaled = F.transform(F.arrays_zip(chosen.alias("x"), c.alias("c"), d.alias("d")), lambda t: (t["x"] - t["c"]) / t["d"])
    table = materialize(train.select(F.col(key).alias("row_id"), F.col(y).alias("y"), scaled.alias("x")))
    names = [f"x{i}" for i in range(len(idx))]
    columns = table.select("row_id", "y", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)])
    if kind in ("lasso", "elastic"):
        m = lin.lasso(columns, names, "y", g("alpha")) if kind == "lasso" else \
            lin.elastic_net(columns, names, "y", g("alpha"), g("l1_ratio"))
        model.state = {"w": [float(v) for v in m.coefficients], "b": float(m.intercept)}
    elif kind in ("xgb", "lgbm"):
        depth = int(g("max_depth", 6))
        leaves = 2 ** depth if kind == "xgb" else int(g("num_leaves", 31))
        model.kind = "trees"
        model.nodes = fit_boosting(table, "x", "y", rounds=int(g("n_estimators", 100)), learning_rate=g("learning_rate", 0.1),
                                   num_leaves=leaves, max_depth=depth, min_rows=1 if kind == "xgb" else 20,
                                   l2=1.0 if kind == "xgb" else 0.0, subsample=g("subsample", 1.0),
                                   colsample=g("colsample_bytree", 1.0)).nodes(spark).toPandas()
    elif kind in ("dt", "rf", "gbr", "bagging"):
        name, options = {
            "dt": ("tree", dict(maxDepth=min(30, int(g("max_depth", 5))))),
            "rf": ("forest", dict(numTrees=int(g("n_estimators", 100)), maxDepth=min(30, int(g("max_depth", 5))))),
            "gbr": ("boosted", dict(maxIter=int(g("n_estimators", 100)), stepSize=g("learning_rate", 0.1),
                                    maxDepth=int(g("max_depth", 3)))),
            "bagging": ("bagging", dict(numTrees=int(g("n_estimators", 10))))}[kind]
        if kind in ("dt", "rf"):
            options["minInstancesPerNode"] = max(1, int(g("min_samples_split", 2)) // 2)
        fitted = tr.fit_tree_model(columns, names, "y", name, **options)
        model.kind, model.nodes = "trees", tr.tree_nodes(fitted, ensure_checkpoint_dir(spark)).toPandas()
    elif kind == "extra":
        model.kind = "trees"
        model.nodes = en.extra_trees(table, "x", "y", int(g("n_estimators", 100)), min(20, int(g("max_depth", 8)))).toPandas()
    elif kind == "ada":
        found, weights = en.ada_boost_r2(columns, names, "y", int(g("n_estimators", 50)), g("learning_rate", 1.0))
        model.kind, model.nodes = "median", en.ada_nodes(found, weights)
    elif kind == "svr":
        m = en.rbf_regression(table, "x", "y", C=g("C", 1.0), gamma=g("gamma", 0.1))
        rng = np.random.default_rng(m["seed"])   # the features of kernel.random_fourier_features
        omega = rng.normal(0.0, np.sqrt(2.0 * m["gamma"]), (len(idx), m["n_features"]))
        phase = rng.uniform(0.0, 2 * np.pi, m["n_features"])
        model.kind = "kernel"
        model.state = {"omega": omega.tolist(), "phase": phase.tolist(), "w": [float(v) for v in m["w"]], "b": float(m["b"]),
                       "mu": float(m["mu"]), "sd": float(m["sd"])}
    else:
        raise ValueError(kind)
    return model


def refit_best(spark: SparkSession, path: str, train: DataFrame, features: str, y: str, wide: int = WIDE) -> tuple[dict, TrialModel]:
    """The best completed trial of every saved run, and its model fitted to all training rows."""
    from .search import best_trial, completed
    saved = spark.read.json(path)
    best = best_trial(completed(saved)).first()
    if best is None or best["trial"] is None:
        raise ValueError("no completed trial has been saved")
    row = best.asDict(recursive=True)
    params = {k: v for k, v in row["params"].items() if v is not None}
    return row, fit_trial(train, features, y, params, wide)
