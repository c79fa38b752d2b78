"""Sweep-file stream: pick up new files once, score each, log, quarantine (ST1–ST5, ST11, J5, U3).

* ST1: file source with a declared schema, ``*.csv`` only, non-recursive.
* ST2: the checkpoint's file log makes every file processed exactly once,
  also across restarts (the reference kept an in-memory set).
* ST3: writers must move finished files into the directory atomically
  (rename); ``maxFilesPerTrigger`` bounds a micro-batch.
* ST4: a file is complete inside one micro-batch, so per-file ordered
  aggregation runs in ``foreachBatch`` on a static DataFrame.
* ST11: files failing the sweep check (P1) or numeric coercion (F13) go to a
  quarantine sink with the reason instead of stopping the stream.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import sweep_time
from ..session import TableStore
from ..sources.files import MEASURES, parse_sweep_lines

def sweep_stream(spark: SparkSession, directory: str, pattern: str = "*.csv",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """ST1: lines of every new sweep file with their file and place.

    ST3: a file counts once its writer has renamed it into the directory.
    """
    r = spark.readStream.option("pathGlobFilter", pattern)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.text(directory).select(
        "value", F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block"))


def parse_batch(batch: DataFrame) -> DataFrame:
    """Per micro-batch: line order within each file and measurements bound by header name."""
    b = parse_sweep_lines(batch.withColumn("__line", F.monotonically_increasing_id()))
    any_bad = F.col("bad_line")
    for n in MEASURES:
        any_bad = any_bad | (F.col(f"raw_{n}").isNotNull() & F.col(n).isNull())
    return b.select("file", "__path", F.struct("__block", "__line").alias("__line"), *MEASURES,
                    any_bad.alias("bad_value"), *[F.col(f"raw_{n}").isNull().alias(f"missing_{n}") for n in MEASURES])


def _field(name: str):
    return lambda r: r[name]


def file_features(parsed: DataFrame, expected_points: int | None = None) -> tuple[DataFrame, DataFrame]:
    """P1 + P5 per file: (file, ts, n_points, features) and quarantined (file, reason).

    features = freq ‖ return loss ‖ phase ‖ Xs in line order (measurement-major).
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col("__line"), *[F.col(n) for n in MEASURES])))
    agg = parsed.groupBy("__path", "file").agg(
        ordered.alias("__rows"), F.count(F.lit(1)).alias("n_points"),
        F.count_if("bad_value").alias("n_bad"),
        *[F.count_if(f"missing_{n}").alias(f"n_missing_{n}") for n in MEASURES])
    missing_any = None
    for n in MEASURES:
        c = F.col(f"n_missing_{n}") == F.col("n_points")
        missing_any = c if missing_any is None else (missing_any | c)
    reason = F.when(missing_any, F.lit("missing column")) \
        .when(F.col("n_bad") > 0, F.lit("non-numeric value"))
    if expected_points is not None:
        reason = reason.when(F.col("n_points") != expected_points, F.lit("wrong point count"))
    agg = agg.withColumn("reason", reason)
    feats = F.concat(*[F.transform("__rows", _field(n)) for n in MEASURES])
    good = agg.where(F.col("reason").isNull()).select(
        "file", sweep_time("file").alias("ts"), F.col("n_points").cast("bigint"), feats.alias("features"))
    bad = agg.where(F.col("reason").isNotNull()).select("file", "reason")
    return good, bad


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], sink: str,
                 quarantine: str, checkpoint: str, expected_points: int | None = None,
                 available_now: bool = False, interval: str = "1 second"):
    """ST4 + S10 + ST11: score every complete file once and append the result.

    ``scorer`` maps (file, ts, n_points, features) → adds ``prediction``.  A
    batch is parsed once and stored until both sinks have it; each sink gets it as the partition folder of
    its batch id, overwritten when a batch is retried, so no row is written twice.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        store = TableStore(batch.sparkSession)
        try:   # the batch's copy goes when both sinks have it
            stored = store.write(parse_batch(batch), f"batch-{batch_id}")
            good, bad = file_features(stored, expected_points)
            scored = scorer(good).select("file", "ts", "prediction")
            for rows, path in ((scored, sink), (bad.select("file", "reason"), quarantine)):
                rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
        finally:
            store.close()

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def linear_scorer(weights: list[float], intercept: float, keep: list[int] | None = None,
                  center: list[float] | None = None, scale: list[float] | None = None):
    """X4 for a linear model: mask → scale → dot product, all as array expressions."""
    w = F.lit(np.array(weights, float))   # one literal whatever the width

    def score(df: DataFrame) -> DataFrame:
        x = _prepare_x(keep, center, scale)
        dot = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        return df.withColumn("prediction", dot + F.lit(float(intercept)))
    return score


def _prepare_x(keep, center, scale):
    x = F.col("features")
    if keep is not None:
        x = F.transform(F.lit(np.array(keep, np.int32) + 1), lambda i: F.element_at(F.col("features"), i))
    if center is not None:
        cs = F.arrays_zip(F.lit(np.array(center, float)).alias("c"), F.lit(np.array(scale, float)).alias("s"))
        x = F.zip_with(x, cs, lambda v, p: (v - p["c"]) / p["s"])
    return x


def tree_scorer(nodes: DataFrame, keep: list[int] | None = None, center: list[float] | None = None,
                scale: list[float] | None = None):
    """X4 for a tree ensemble: mask → scale → node-table walk.

    The node arrays are broadcast once when the scorer is built, then reused
    by every micro-batch.
    """
    from ..operators.trees import predict_prepared, prepare_trees
    bc = prepare_trees(nodes)

    def score(df: DataFrame) -> DataFrame:
        x = df.withColumn("__x", _prepare_x(keep, center, scale))
        # one row of a batch is one file, so the join is on its unique name
        p = predict_prepared(x, bc, "__x", key="file")
        return df.join(p, "file")
    return score


def running_totals(scored: DataFrame) -> DataFrame:
    """ST5: running count and last prediction (global streaming aggregate, complete mode)."""
    return scored.agg(F.count(F.lit(1)).alias("n_scored"),
                      F.max_by("prediction", F.struct("ts", "file")).alias("last_prediction"),
                      F.max("ts").alias("last_ts"))


def unseen(files: DataFrame, seen: DataFrame, key: str = "file") -> DataFrame:
    """J5/U3 batch form: files not processed yet (left anti join on the file key)."""
    return files.select(key).distinct().join(seen.select(key).distinct(), key, "left_anti")


PREDICTION_SCHEMA = T.StructType([T.StructField("file", T.StringType()), T.StructField("ts", T.TimestampType()),
                                  T.StructField("prediction", T.DoubleType()),
                                  T.StructField("batch_id", T.LongType())])
