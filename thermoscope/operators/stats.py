"""Long-form feature statistics and sweep summaries.

Wide sweeps (40,004 values) stay in long form ``(row_id, feature_id, value)``;
per-feature statistics are one ``groupBy(feature_id)`` with map-side partial
aggregation, so the shuffle carries one buffer per (partition, feature).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_corr
from .ranking import exact_quantiles


def feature_stats(long: DataFrame, feature: str = "feature_id", value: str = "value",
                  y: str | None = "y", digits: int = 6) -> DataFrame:
    """n, missing, mean, var_pop, std_pop, min, max (and corr with y) per feature."""
    v = F.col(value)
    valid = F.when(~F.isnan(v), v)
    aggs = [
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.count_if(v.isNull() | F.isnan(v)).cast("bigint").alias("n_missing"),
        F.round(F.avg(valid), digits).alias("mean"),
        F.round(F.var_pop(valid), digits).alias("var_pop"),
        F.round(F.stddev_pop(valid), digits).alias("std_pop"),
        F.round(F.min(valid), digits).alias("min"),
        F.round(F.max(valid), digits).alias("max"),
    ]
    if y:
        aggs.append(F.round(safe_corr(valid, F.col(y)), digits).alias("corr_y"))
    return long.groupBy(feature).agg(*aggs)


def feature_quartiles(long: DataFrame, feature: str = "feature_id", value: str = "value",
                      key: str = "row_id", digits: int | None = None) -> DataFrame:
    """Exact interpolated p25 / median / p75 per feature, skew-safe."""
    q = exact_quantiles(long, value, [0.25, 0.5, 0.75], by=[feature], tiebreak=[key],
                        names=["p25", "median", "p75"])
    if digits is None:
        return q
    return q.select(feature, *[F.round(c, digits).alias(c) for c in ("p25", "median", "p75")])


def has_missing(long: DataFrame, feature: str = "feature_id", value: str = "value") -> DataFrame:
    """Per feature, is any value NULL/NaN — decides whether to impute."""
    v = F.col(value)
    return long.groupBy(feature).agg(F.bool_or(v.isNull() | F.isnan(v)).alias("has_missing"))


def summarize_sweep(long: DataFrame, by: Sequence[str] = ("sweep_id", "measurement"),
                    value: str = "value") -> DataFrame:
    """Mean, std (population), min, max, p25, p75 per sweep and measurement.

    A group is one sweep's points for one measurement (10,001 at most), so the
    exact ``percentile`` buffer is bounded by the sweep length.
    """
    v = F.col(value)
    return long.groupBy(*by).agg(
        F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"),
        F.round(F.min(v), 6).alias("min"), F.round(F.max(v), 6).alias("max"),
        F.round(F.percentile(v, 0.25), 6).alias("p25"),
        F.round(F.percentile(v, 0.75), 6).alias("p75"))


def flatten_sweep(long: DataFrame, sweep: str = "sweep_id",
                  order: Sequence[str] = ("measurement", "point_idx"),
                  value: str = "value", out: str = "features") -> DataFrame:
    """P5: one ordered array per sweep — measurement-major, point-minor."""
    s = F.struct(*[F.col(o) for o in order], F.col(value).alias("v"))
    return long.groupBy(sweep).agg(
        F.transform(F.array_sort(F.collect_list(s)), lambda x: x["v"]).alias(out))


def check_sweep(long: DataFrame, sweep: str = "sweep_id", measurement: str = "measurement",
                value: str = "value", n_measurements: int = 4, n_points: int | None = None) -> DataFrame:
    """Per sweep, measurement count, point count and NULL values → valid flag."""
    per = long.groupBy(sweep, measurement).agg(
        F.count(F.lit(1)).alias("pts"), F.count_if(F.col(value).isNull()).alias("nulls"))
    out = per.groupBy(sweep).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_measurements"),
        F.min("pts").cast("bigint").alias("min_points"),
        F.max("pts").cast("bigint").alias("max_points"),
        F.sum("nulls").cast("bigint").alias("n_null"))
    ok = (F.col("n_measurements") == n_measurements) & (F.col("n_null") == 0) & \
        (F.col("min_points") == F.col("max_points"))
    if n_points is not None:
        ok = ok & (F.col("min_points") == n_points)
    return out.withColumn("valid", ok)


# Data-quality rules (z-score limit, samples per feature, missing share).
Z_LIMIT, MIN_SAMPLES_PER_FEATURE, MAX_MISSING_SHARE = 3.0, 5, 0.10


def quality_report(long: DataFrame, targets: DataFrame, key: str = "row_id",
                   feature: str = "feature_id", value: str = "value",
                   rows: DataFrame | None = None) -> DataFrame:
    """One row per rule with the measured value and pass flag.

    The per-feature mean/std table has one row per feature (bounded by the
    sweep width) and is broadcast to score z-values.  With ``rows`` (the wide
    predictor table, one row per sample) the sample count is its row count;
    otherwise it is the distinct keys of the long form (a shuffle of every cell).
    """
    cell = F.when(~F.isnan(value), F.col(value))   # a missing cell has no z-value and moves no mean
    st = long.groupBy(feature).agg(F.avg(cell).alias("__m"), F.stddev_pop(cell).alias("__s"))
    z = long.join(F.broadcast(st), feature).select(
        F.when(F.isnan(value), F.lit(None).cast("double")).when(F.col("__s") > 0, F.abs((F.col(value) - F.col("__m")) / F.col("__s")))
        .otherwise(F.lit(0.0)).alias("z"), F.col(value), F.col(key), F.col(feature))
    n_rows = F.lit(rows.count()) if rows is not None else F.countDistinct(key)
    a = z.agg(F.count(F.lit(1)).alias("cells"),
              F.count_if(F.col("z") > Z_LIMIT).alias("n_outlier_cells"),
              F.count_if(F.col(value).isNull() | F.isnan(F.col(value))).alias("n_missing"),
              n_rows.alias("n_rows"),
              F.count_distinct(feature).alias("n_features"))
    j = a.withColumn("n_targets", F.lit(targets.count()))  # one scalar
    rules = F.array(
        F.struct(F.lit("z_outlier_cells").alias("rule"), F.col("n_outlier_cells").cast("double").alias("value"),
                 (F.col("n_outlier_cells") == 0).alias("passed")),
        F.struct(F.lit("samples_per_feature").alias("rule"),
                 F.round(F.col("n_rows") / F.col("n_features"), 6).alias("value"),
                 (F.col("n_rows") / F.col("n_features") >= MIN_SAMPLES_PER_FEATURE).alias("passed")),
        F.struct(F.lit("missing_share").alias("rule"),
                 F.round(F.col("n_missing") / F.col("cells"), 6).alias("value"),
                 (F.col("n_missing") / F.col("cells") <= MAX_MISSING_SHARE).alias("passed")),
        F.struct(F.lit("x_y_count_gap").alias("rule"),
                 (F.col("n_rows") - F.col("n_targets")).cast("double").alias("value"),
                 (F.col("n_rows") == F.col("n_targets")).alias("passed")))
    return j.select(F.inline(rules))
