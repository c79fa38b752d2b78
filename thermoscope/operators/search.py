"""Hyperparameter trials as tables.

A study is a DataFrame ``(trial, model_type, params MAP<STRING,STRING>,
value, state)``.  Draws are md5-hash based (portable and reproducible);
linear trials are scored from the shared per-fold Gram statistics (one data
pass for any number of trials), tree trials from MLlib fits on the same
folds.  History, stop rule, best trial, slices and importance are ordinary
queries over the (bounded) trial table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_unit

# Search space per family (name, kind, low, high) as in the reference.
SPACE = {
    "ridge": (("ridge_alpha", "log", 1e-3, 100.0),),
    "elastic": (("elastic_alpha", "log", 1e-3, 10.0), ("elastic_l1_ratio", "uniform", 0.1, 0.9)),
    "lasso": (("lasso_alpha", "log", 1e-3, 10.0),),
    "dt": (("dt_max_depth", "int", 3, 20), ("dt_min_samples_split", "int", 2, 10)),
    "extra": (("extra_n_estimators", "int", 50, 300), ("extra_max_depth", "int", 3, 20)),
    "gbr": (("gbr_n_estimators", "int", 50, 300), ("gbr_learning_rate", "uniform", 0.01, 0.3),
            ("gbr_max_depth", "int", 3, 10)),
    "rf": (("rf_n_estimators", "int", 50, 300), ("rf_max_depth", "int", 5, 20),
           ("rf_min_samples_split", "int", 2, 10)),
    "svr": (("svr_C", "log", 0.1, 100.0), ("svr_gamma", "log", 1e-4, 1.0)),
    "bagging": (("bagging_n_estimators", "int", 10, 100),),
    "ada": (("ada_n_estimators", "int", 50, 200), ("ada_learning_rate", "uniform", 0.01, 2.0)),
}
# Families beside SPACE; the boosters' device choices have no counterpart here.
OPTIONAL_SPACE = {
    "xgb": (("xgb_n_estimators", "int", 50, 300), ("xgb_learning_rate", "uniform", 0.01, 0.3), ("xgb_max_depth", "int", 3, 10),
            ("xgb_subsample", "uniform", 0.6, 1.0), ("xgb_colsample_bytree", "uniform", 0.6, 1.0)),
    "lgbm": (("lgbm_n_estimators", "int", 50, 300), ("lgbm_learning_rate", "uniform", 0.01, 0.3),
             ("lgbm_max_depth", "int", 3, 10), ("lgbm_num_leaves", "int", 10, 300), ("lgbm_subsample", "uniform", 0.6, 1.0),
             ("lgbm_colsample_bytree", "uniform", 0.6, 1.0)),
    "ridge_cv": (),   # its penalty is chosen inside each fold
}
SCALERS = ("robust", "standard")
SELECTION = ("True", "False")
K_FEATURES = (100, 500)   # drawn only when selection is on and the width exceeds 500
FAILED_SCORE, FOLD_FLOOR = -999.0, -5.0
SEED = 42


def draw(trial: Column, name: str, kind: str, lo: float, hi: float, seed: int = SEED) -> Column:
    """one portable draw per (trial, parameter)."""
    u = hash_unit(trial, f"{seed}:{name}")
    if kind == "log":
        return F.exp(F.lit(math.log(lo)) + u * F.lit(math.log(hi / lo)))
    if kind == "uniform":
        return F.lit(lo) + u * F.lit(hi - lo)
    if kind == "int":
        return (F.lit(int(lo)) + F.floor(u * F.lit(int(hi) - int(lo) + 1))).cast("bigint")
    raise ValueError(kind)


def choice(trial: Column, name: str, options: Sequence[str], seed: int = SEED) -> Column:
    u = hash_unit(trial, f"{seed}:{name}")
    return F.element_at(F.array(*[F.lit(o) for o in options]),
                        (F.floor(u * len(options)) + 1).cast("int"))


def sample_trials(spark: SparkSession, n: int, families: Sequence[str] = tuple(SPACE),
                  seed: int = SEED, n_features: int | None = None, wide: int = 500,
                  k_range: tuple[int, int] = K_FEATURES) -> DataFrame:
    """N trials; each draws a family, then only that family's parameters,
    plus the preprocessing choices (scaler type, selection on/off and — only
    when selection is on and the data is wider than 500 — k_features)."""
    t = spark.range(n).select(F.col("id").cast("int").alias("trial"))
    fam = choice(F.col("trial"), "model_type", list(families), seed)
    sel = choice(F.col("trial"), "use_feature_selection", SELECTION, seed)
    entries = [F.struct(F.lit("model_type").alias("k"), fam.alias("v")),
               F.struct(F.lit("scaler_type").alias("k"),
                        choice(F.col("trial"), "scaler_type", SCALERS, seed).alias("v")),
               F.struct(F.lit("use_feature_selection").alias("k"), sel.alias("v"))]
    if n_features is not None and n_features > wide:
        hi = min(k_range[1], n_features)
        entries.append(F.struct(F.lit("k_features").alias("k"), F.when(
            sel == "True", draw(F.col("trial"), "k_features", "int", k_range[0], hi, seed).cast("string"))
            .alias("v")))
    for f in families:
        for name, kind, lo, hi in {**SPACE, **OPTIONAL_SPACE}[f]:
            entries.append(F.struct(F.lit(name).alias("k"),
                                    draw(F.col("trial"), name, kind, lo, hi, seed).cast("string").alias("v")))
    allp = F.map_from_entries(F.array(*entries))
    t = t.withColumn("model_type", fam).withColumn("__all", allp)
    keep = F.map_filter("__all", lambda k, v: v.isNotNull() & (
        (k == "model_type") | (k == "scaler_type") | (k == "use_feature_selection") | (k == "k_features") |
        k.startswith(F.concat(F.col("model_type"), F.lit("_")))))
    return t.select("trial", "model_type", keep.alias("params"))


#: Why a trial's fold failed, by (trial, fold), of this session's evaluations.
TRIAL_ERRORS: dict[tuple, str] = {}


def _is_cluster_failure(e: Exception) -> bool:
    text = str(e)
    return any(x in text for x in ("ExecutorLostFailure", "OutOfMemoryError", "FetchFailed", "SparkContext was shut down",
                                   "Stage cancelled", "worker exited unexpectedly"))


def family_params(trials: DataFrame) -> DataFrame:
    """Keep the chosen family's keys and strip the ``{family}_`` prefix."""
    pre = F.concat(F.col("model_type"), F.lit("_"))
    own = F.map_filter("params", lambda k, v: k.startswith(pre))
    return trials.withColumn("family_params", F.transform_keys(
        own, lambda k, v: F.substr(k, F.length(pre) + 1)))


def completed(trials: DataFrame) -> DataFrame:
    """Trials whose state is COMPLETE."""
    return trials.where(F.col("state") == "COMPLETE")


def trial_score(fold_scores: DataFrame, trial: str = "trial", score: str = "r2") -> DataFrame:
    """Mean fold R²; NaN/NULL or any fold below −5 → −999."""
    s = F.col(score)
    agg = fold_scores.groupBy(trial).agg(
        F.avg(s).alias("__mean"), F.min(s).alias("min_fold"),
        F.count_if(s.isNull() | F.isnan(s)).alias("__bad"),
        F.count(F.lit(1)).cast("bigint").alias("n_folds"))
    value = F.when((F.col("__bad") > 0) | F.isnan("__mean") | (F.col("min_fold") < FOLD_FLOOR),
                   F.lit(FAILED_SCORE)).otherwise(F.col("__mean"))
    return agg.select(trial, "n_folds", "min_fold", value.alias("value"),
                      F.when(F.col("__bad") > 0, "FAIL").otherwise("COMPLETE").alias("state"))


def trial_history(study: DataFrame, trial: str = "trial", value: str = "value") -> DataFrame:
    """Best value so far in trial order.

    The window runs over the trial table (bounded by the trial cap), not data.
    """
    w = Window.orderBy(trial).rowsBetween(Window.unboundedPreceding, 0)
    return study.withColumn("best_so_far", F.max(value).over(w))


def stop_at(history: DataFrame, ceiling: float | Column, tol: float = 0.01,
            trial: str = "trial") -> DataFrame:
    """Keep trials up to the first whose best-so-far reaches ceiling − tol."""
    c = F.lit(ceiling) if not isinstance(ceiling, Column) else ceiling
    hit = history.where(F.col("best_so_far") >= c - tol).agg(F.min(trial)).first()[0]
    return history if hit is None else history.where(F.col(trial) <= hit)


def best_trial(study: DataFrame, trial: str = "trial", value: str = "value") -> DataFrame:
    """T4: highest value, earliest trial on ties."""
    key = F.struct(F.col(value), -F.col(trial))
    cols = [c for c in study.columns]
    return study.agg(F.max_by(F.struct(*cols), key).alias("b")).select("b.*")


def slices(study: DataFrame) -> DataFrame:
    """One row per (trial, parameter, value, score)."""
    return study.select("trial", F.explode("params").alias("param", "param_value"), "value")


def importance(study: DataFrame, bins: int = 5) -> DataFrame:
    """M40 (re-aimed): share of score variance explained by each parameter's bins.

    Numeric values are cut into equal-width bins per parameter, text values
    are their own bins; importance = between-bin variance / total variance.
    """
    s = slices(study).where(F.col("value") > FAILED_SCORE)
    num = F.col("param_value").try_cast("double")
    rng = s.groupBy("param").agg(F.min(num).alias("__lo"), F.max(num).alias("__hi"))
    s = s.join(rng, "param")
    width = F.col("__hi") - F.col("__lo")
    b = F.when(num.isNull(), F.col("param_value")).otherwise(
        F.when(width > 0, F.least(F.lit(bins - 1), F.floor((num - F.col("__lo")) / width * bins)))
        .otherwise(F.lit(0)).cast("string"))
    s = s.withColumn("bin", b)
    per_bin = s.groupBy("param", "bin").agg(F.count(F.lit(1)).alias("nb"), F.avg("value").alias("mb"))
    tot = s.groupBy("param").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"),
                                 F.var_pop("value").alias("v"))
    j = per_bin.join(tot, "param")
    between = j.groupBy("param").agg(
        (F.sum(F.col("nb") * (F.col("mb") - F.col("m")) ** 2) / F.first("n")).alias("between"),
        F.first("v").alias("total"))
    return between.select("param", F.when(F.col("total") > 0, F.col("between") / F.col("total"))
                          .otherwise(F.lit(0.0)).alias("importance"))


def ridge_trial_scores(spark: SparkSession, folded: DataFrame, features: Sequence[str], y: str,
                       trials: DataFrame, standardize: bool = False) -> DataFrame:
    """M35/J6 for ridge trials: every (trial, fold) R² from one Gram job.

    The trial × fold expansion happens on the driver over k×k statistics,
    never on data rows.  Scaling is fitted inside each fold: ``standard``
    from the training Gram diagonal, ``robust`` from the exact IQR of the
    training rows (one extra ranked pass, shared by all robust trials).
    """
    from .linear import bucket_stats, fold_train_iqr, r2_on, solve_ridge
    from .trials import best_features, drawn_k, take
    rows = trials.select("trial", F.col("params")["ridge_alpha"].cast("double").alias("alpha"),
                         F.coalesce(F.col("params")["scaler_type"], F.lit("none")).alias("scaler")).collect()
    alphas = {int(r["trial"]): (float(r["alpha"]), r["scaler"]) for r in rows}   # bounded by the trial cap
    ks = {int(r["trial"]): drawn_k(dict(r["params"]), len(features), 0) for r in trials.select("trial", "params").collect()}
    stats = bucket_stats(folded, features, y, ["repeat", "fold"])
    iqr = fold_train_iqr(folded, features) if any(v[1] == "robust" for v in alphas.values()) else {}
    out = []
    for rep in sorted({r for r, _ in stats}):
        buckets = {f: s for (r, f), s in stats.items() if r == rep}
        total = None
        for s in buckets.values():
            total = s if total is None else total + s
        for f, s in sorted(buckets.items()):
            train = total - s
            for t, (a, scaler) in alphas.items():
                idx = best_features(train, ks[t])
                kept = take(train, idx)
                if scaler == "robust":
                    w, b = solve_ridge(kept, a, scale=iqr[(rep, f)][idx])
                else:
                    w, b = solve_ridge(kept, a, standardize or scaler == "standard")
                out.append((t, int(rep), int(f), float(r2_on(take(s, idx), w, b))))
    schema = T.StructType([T.StructField("trial", T.IntegerType()), T.StructField("repeat", T.IntegerType()),
                           T.StructField("fold", T.IntegerType()), T.StructField("r2", T.DoubleType())])
    return spark.createDataFrame(out, schema)


def run_search(spark: SparkSession, evaluate: Callable[[DataFrame], DataFrame], trials: DataFrame,
               ceiling: float, batch: int = 20, tol: float = 0.01,
               callback: Callable[[DataFrame, dict], None] | None = None) -> DataFrame:
    """X5/W3 driver loop: evaluate trials in batches, call back after each
    batch, stop once the best value reaches ``ceiling − tol``."""
    n = trials.count()
    done = None
    best = -math.inf
    for lo in range(0, n, batch):
        chunk = trials.where((F.col("trial") >= lo) & (F.col("trial") < lo + batch))
        scored = evaluate(chunk).join(chunk, "trial")
        done = scored if done is None else done.unionByName(scored)
        top = scored.agg(F.max("value")).first()[0]
        best = max(best, top if top is not None else -math.inf)
        if callback:
            callback(done, {"trials_done": min(lo + batch, n), "best": best})
        if best >= ceiling - tol:
            break
    return done


def save_trials(study: DataFrame, path: str) -> None:
    """Append this run's trials (JSON, one new file set per run)."""
    from ..sources.sinks import save_trials as _save
    _save(study, path)


def resume_best(spark: SparkSession, path: str) -> DataFrame:
    """Best completed trial across every saved run."""
    saved = spark.read.json(path)
    return best_trial(completed(saved))


# ------------------------------------------------ evaluating any family

def _fold_scale(train: DataFrame, features: Sequence[str], kind: str):
    """Fit the drawn scaler on a training fold; returns a column mapper."""
    from .ranking import exact_quantiles
    if kind == "standard":
        st = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
                       *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
        cs = [(st[f"m{i}"], st[f"s{i}"] or 1.0) for i in range(len(features))]
    else:
        cs = []
        for c in features:
            q = exact_quantiles(train.select("row_id", c), c, [0.25, 0.5, 0.75], tiebreak=["row_id"],
                                names=["a", "b", "d"]).first()
            iqr = (q["d"] - q["a"]) or 1.0
            cs.append((q["b"], iqr))
    return lambda df: df.select("*", *[((F.col(c) - F.lit(m)) / F.lit(s)).alias(f"__z{i}")
                                      for i, (c, (m, s)) in enumerate(zip(features, cs))])


def _fold_features(train: DataFrame, features: Sequence[str], y: str, params: dict) -> list[str]:
    """The columns a trial keeps in one fold: its ``k_features`` of greatest F on the training rows."""
    k = int(float(params.get("k_features", 0))) if params.get("use_feature_selection") == "True" else 0
    if not 0 < k < len(features):
        return list(features)
    st = train.agg(*[F.abs(F.corr(c, y)).alias(f"r{i}") for i, c in enumerate(features)]).first()
    strength = [0.0 if st[i] is None or math.isnan(st[i]) else st[i] for i in range(len(features))]   # F grows with |r|
    top = sorted(range(len(features)), key=lambda i: (-strength[i], i))[:k]
    return [features[i] for i in sorted(top)]


def _fit_predict(kind: str, p: dict, train: DataFrame, val: DataFrame, feats: list[str], y: str) -> DataFrame:
    from . import ensembles as en
    from . import linear as lin
    from . import trees as tr
    g = lambda k, d=None: float(p.get(f"{kind}_{k}", d))
    if kind in ("lasso", "elastic"):
        m = lin.lasso(train, feats, y, g("alpha")) if kind == "lasso" else \
            lin.elastic_net(train, feats, y, g("alpha"), g("l1_ratio"))
        return m.transform(tr.assemble(val, feats))
    if kind in ("dt", "rf", "gbr", "bagging"):
        split = int(g("min_samples_split", 2))
        params = {"dt": dict(maxDepth=min(30, int(g("max_depth", 5))), minInstancesPerNode=max(1, split // 2)),
                  "rf": dict(numTrees=int(g("n_estimators", 100)), maxDepth=min(30, int(g("max_depth", 5))),
                             minInstancesPerNode=max(1, split // 2)),
                  "gbr": dict(maxIter=int(g("n_estimators", 100)), stepSize=g("learning_rate", 0.1),
                              maxDepth=int(g("max_depth", 3))),
                  "bagging": dict(numTrees=int(g("n_estimators", 10)))}[kind]
        name = {"dt": "tree", "rf": "forest", "gbr": "boosted", "bagging": "bagging"}[kind]
        m = tr.fit_tree_model(train, feats, y, name, **params)
        return m.transform(tr.assemble(val, feats))
    arr = lambda df: df.withColumn("__f", F.array(*[F.col(c) for c in feats]))
    if kind == "extra":
        nodes = en.extra_trees(arr(train), "__f", y, int(g("n_estimators", 100)), min(20, int(g("max_depth", 8))))
        return en.extra_trees_predict(arr(val), "__f", nodes).join(val, "row_id")
    if kind in ("xgb", "lgbm"):
        from .boosting import fit_boosting
        depth = int(g("max_depth", 6))
        model = fit_boosting(arr(train), "__f", y, rounds=int(g("n_estimators", 100)), learning_rate=g("learning_rate", 0.1),
                             num_leaves=2 ** depth if kind == "xgb" else int(g("num_leaves", 31)), max_depth=depth,
                             min_rows=1 if kind == "xgb" else 20, l2=1.0 if kind == "xgb" else 0.0,
                             subsample=g("subsample", 1.0), colsample=g("colsample_bytree", 1.0))
        return model.transform(arr(val), "__f")
    if kind == "ada":
        models, w = en.ada_boost_r2(train, feats, y, int(g("n_estimators", 50)), g("learning_rate", 1.0))
        return en.ada_predict(val, feats, models, w).join(val, "row_id")
    if kind == "svr":
        model = en.rbf_regression(arr(train), "__f", y, C=g("C", 1.0), gamma=g("gamma", 0.1), iters=40)
        return en.rbf_predict(arr(val), "__f", model).join(val, "row_id")
    raise ValueError(kind)


def evaluate_trials(spark: SparkSession, folded: DataFrame, features: Sequence[str], y: str,
                    trials: DataFrame, threads: int = 4) -> DataFrame:
    """M35 for any family: (trial, n_folds, min_fold, value, state).

    Ridge trials come from the shared Gram job; every other trial fits its
    MLlib/engine model on each training fold (scaler fitted on that fold) and
    scores the held-out fold.  Trials run concurrently from driver threads;
    a failing trial is recorded as FAIL / −999 instead of stopping the study.
    """
    from concurrent.futures import ThreadPoolExecutor
    from .metrics import r2_expr
    ridge = trials.where(F.col("model_type") == "ridge")
    out = []
    if ridge.limit(1).count():
        out.append(trial_score(ridge_trial_scores(spark, folded, features, y, ridge)))
    others = [r.asDict() for r in trials.where(F.col("model_type") != "ridge").collect()]   # ≤ batch size
    folds = sorted(r[0] for r in folded.select("fold").distinct().collect())

    def run_fold(t, f):
        try:
            train = folded.where(F.col("fold") != f)
            val = folded.where(F.col("fold") == f)
            feats = _fold_features(train, features, y, t["params"])
            scale = _fold_scale(train, feats, t["params"].get("scaler_type", "standard"))
            zf = [f"__z{i}" for i in range(len(feats))]
            pred = _fit_predict(t["model_type"], t["params"], scale(train), scale(val), zf, y)
            err = (F.col(y) - F.col("prediction")) ** 2
            r2 = pred.agg(r2_expr(F.sum(err), F.var_pop(y) * F.count(y))).first()[0]
            return t["trial"], int(f), float(r2)
        except Exception as e:   # a trial whose parameters do not fit scores −999
            if _is_cluster_failure(e):
                raise            # lost executors or memory are no property of the trial
            TRIAL_ERRORS[(t["trial"], int(f))] = f"{type(e).__name__}: {e}"[:500]
            return t["trial"], int(f), float("nan")

    jobs = [(t, f) for t in others for f in folds]   # trials × folds run as concurrent Spark jobs
    with ThreadPoolExecutor(max_workers=max(1, threads * len(folds))) as ex:
        rows = list(ex.map(lambda j: run_fold(*j), jobs))
    if rows:
        fs = spark.createDataFrame(rows, "trial int, fold int, r2 double")
        out.append(trial_score(fs))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res
