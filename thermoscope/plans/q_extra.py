"""Queries for generators, file bookkeeping, ensembles MLlib lacks, refits and diagnostics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import sweep_file_name
from ..operators import metrics as me
from ..operators.split import sql_split
from ..sources.synth import sql_synth_features, synth_features
from ..sources.tables import load
from .catalog import query
from .features import DOC_FEATURES, SQL_DOC_FEATURES, doc_features_split
from .flagship import ALPHA


@query("s15_synth_feature_summary", f"""
WITH s AS ({sql_synth_features('orders', 'o_orderkey')})
SELECT feature_id, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean,
       round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max
FROM s GROUP BY feature_id
""")
def s15_synth_feature_summary(spark, sf_dir):
    """42 seeded features per order key, summarised per feature."""
    s = synth_features(load(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey")
    return s.groupBy("feature_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.stddev_pop("value"), 6).alias("std"), F.round(F.min("value"), 6).alias("min"),
        F.round(F.max("value"), 6).alias("max"))


@query("j5_u3_unseen_files", """
WITH f AS (SELECT DISTINCT 'live-vna' || strftime(ts, '%y%m%d_%H%M%S') || '.csv' AS file, ts FROM events),
seen AS (SELECT DISTINCT file FROM f WHERE ts < TIMESTAMP '2024-01-15 00:00:00')
SELECT DISTINCT file FROM f WHERE file NOT IN (SELECT file FROM seen)
""")
def j5_u3_unseen_files(spark, sf_dir):
    """Sweep files (named from reading times) not yet in the processed set."""
    from ..streaming.sweeps import unseen
    e = load(spark, sf_dir, "events", "ts")
    files = e.select(sweep_file_name("ts").alias("file"), "ts")
    seen = files.where(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return unseen(files, seen)


def _docs(spark, sf_dir):
    d = doc_features_split(spark, sf_dir).na.fill(0.0, ["avg_word_len"])
    return d.withColumn("features", F.array(*[F.col(c) for c in DOC_FEATURES]))


@query("m30_extra_trees")
def m30_extra_trees(spark, sf_dir):
    """Extremely randomised trees (50 trees, depth 8) fitted on train, test metrics."""
    from ..operators.ensembles import extra_trees, extra_trees_predict
    d = _docs(spark, sf_dir)
    nodes = extra_trees(d.where(F.col("split") == "train"), "features", "y", n_trees=50, max_depth=8)
    test = d.where(F.col("split") == "test")
    p = extra_trees_predict(test, "features", nodes).join(test.select("row_id", "y"), "row_id")
    return me.metrics(p, "y", "prediction").withColumn("model", F.lit("extra_trees"))


@query("m32_adaboost_r2")
def m32_adaboost_r2(spark, sf_dir):
    """AdaBoost.R2 with 50 depth-3 trees, weighted-median combination, test metrics."""
    from ..operators.ensembles import ada_boost_r2, ada_predict
    d = _docs(spark, sf_dir)
    models, weights = ada_boost_r2(d.where(F.col("split") == "train"), list(DOC_FEATURES), "y", 50)
    test = d.where(F.col("split") == "test")
    p = ada_predict(test, list(DOC_FEATURES), models, weights).join(test.select("row_id", "y"), "row_id")
    return me.metrics(p, "y", "prediction").withColumn("rounds", F.lit(len(models)))


@query("m33_rbf_regression")
def m33_rbf_regression(spark, sf_dir):
    """Standardised features → random Fourier features → ε-insensitive fit; test metrics."""
    from ..operators.ensembles import rbf_predict, rbf_regression
    from ..operators.estimators import ArrayScaler
    d = _docs(spark, sf_dir)
    train = d.where(F.col("split") == "train")
    scaler = ArrayScaler(inputCol="features", outputCol="scaled").fit(train)
    tr = scaler.transform(train)
    model = rbf_regression(tr, "scaled", "y", C=10.0, gamma=0.1, iters=60)
    test = scaler.transform(d.where(F.col("split") == "test"))
    p = rbf_predict(test, "scaled", model).join(test.select("row_id", "y"), "row_id")
    return me.metrics(p, "y", "prediction").withColumn("model", F.lit("rbf_rff"))


@query("m36_fit_without_outliers")
def m36_fit_without_outliers(spark, sf_dir):
    """Isolation-forest mask fitted on train only, ridge refit on the inliers,
    test metrics with and without the mask."""
    from ..operators.linear import fit_ridge, linear_predict
    from ..operators.outliers import isolation_forest_mask, keep_rows
    d = _docs(spark, sf_dir)
    train = d.where(F.col("split") == "train")
    mask = isolation_forest_mask(train.select("row_id", "features"))
    inliers = keep_rows(train, mask)
    test = d.where(F.col("split") == "test")
    out = None
    for name, fit_on in (("all_rows", train), ("inliers", inliers)):
        w, b = fit_ridge(fit_on, list(DOC_FEATURES), "y", ALPHA)
        m = me.metrics(test.withColumn("prediction", linear_predict(DOC_FEATURES, w, b)), "y", "prediction")
        m = m.withColumn("fit_on", F.lit(name)).withColumn("n_fit", F.lit(fit_on.count()))
        out = m if out is None else out.unionByName(m)
    return out


@query("m41_diagnostics", f"""
WITH {SQL_DOC_FEATURES.strip()},
s AS (SELECT *, {sql_split('row_id')} AS split FROM doc_features),
fit AS (SELECT covar_pop(n_words, y) * count(*) / (var_pop(n_words) * count(*) + {ALPHA}) AS slope,
               avg(y) AS my, avg(n_words) AS mx FROM s WHERE split = 'train'),
p AS (SELECT s.row_id, s.y, (fit.my - fit.slope * fit.mx) + fit.slope * s.n_words AS prediction
      FROM s, fit WHERE s.split = 'test')
SELECT row_id, round(y, 6) AS actual, round(prediction, 6) AS predicted, round(y - prediction, 6) AS residual,
       round(abs(y - prediction), 6) AS abs_diff FROM p
""")
def m41_diagnostics(spark, sf_dir):
    """Predicted vs actual and residuals on the test split (data for the diagnostic panels)."""
    from ..operators.linear import ridge_1d
    d = doc_features_split(spark, sf_dir)
    slope, icpt = ridge_1d(d.where(F.col("split") == "train"), "n_words", "y", ALPHA)
    t = d.where(F.col("split") == "test").withColumn("prediction", F.lit(icpt) + F.lit(slope) * F.col("n_words"))
    r = me.residuals(t, "y", "prediction")
    return r.select("row_id", F.round("y", 6).alias("actual"), F.round("prediction", 6).alias("predicted"),
                    F.round("residual", 6).alias("residual"), F.round("abs_diff", 6).alias("abs_diff"))


@query("s2_sweep_files_round_trip", """
WITH p AS (SELECT vec_id, embedding, unnest(range(16)) AS point_idx FROM embeddings)
SELECT vec_id, CAST(point_idx AS INTEGER) AS point_idx,
       round(CAST(embedding[point_idx + 1] AS DOUBLE), 6) AS freq_hz,
       round(CAST(embedding[point_idx + 17] AS DOUBLE), 6) AS return_loss_db,
       round(CAST(embedding[point_idx + 33] AS DOUBLE), 6) AS phase_deg,
       round(CAST(embedding[point_idx + 49] AS DOUBLE), 6) AS xs
FROM p
""")
def s2_sweep_files_round_trip(spark, sf_dir):
    """Every vector as a sweep file of 16 points below the shared folder, read back by header names.

    Odd sweeps write their columns in another order and one column more.
    """
    import uuid

    from ..session import ensure_checkpoint_dir, shuffle_partitions
    from ..sources.files import MEASURES, SWEEP_COLUMNS, read_sweeps, write_sweeps
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sweeps-{uuid.uuid4().hex}"
    e = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    cell = lambda i, m: F.coalesce(F.get("embedding", F.lit(16 * m) + i).cast("double").cast("string"), F.lit(""))

    def line(order):
        return lambda i: F.concat_ws(",", *[F.lit("0.5") if m is None else cell(i, m) for m in order])

    head = lambda order: F.lit(",".join("Rs" if m is None else SWEEP_COLUMNS[m] for m in order))
    orders = (0, 1, 2, 3), (2, None, 0, 3, 1)
    texts = [F.concat(F.array(head(o)), F.transform(F.sequence(F.lit(0), F.lit(15)), line(o)))
             for o in orders]
    # equal ids make several files; a fixed number of writers (few bytes, many files)
    same = Window.partitionBy("vec_id").orderBy("embedding")
    name = F.concat_ws("_", F.row_number().over(same), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    pattern = write_sweeps(e.repartition(shuffle_partitions(spark), "vec_id").select(name.alias("sweep"), F.array_join(
        F.when(F.col("vec_id") % 2 == 0, texts[0]).otherwise(texts[1]), "\n").alias("text")), path)
    return read_sweeps(spark, [path], pattern).where(~F.col("bad_line")).select(
        F.regexp_extract("path", r"/sweep=\d+_([^/.]*)", 1).try_cast("long").alias("vec_id"),
        "point_idx", *[F.round(m, 6).alias(m) for m in MEASURES])
