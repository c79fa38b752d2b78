"""Imputation and scaling over the long form.

Fitted constants form a table with one row per feature (bounded by the sweep
width); applying them is a broadcast join plus one column expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import feature_quartiles


def scaler_constants(long: DataFrame, kind: str = "standard", feature: str = "feature_id",
                     value: str = "value", key: str = "row_id") -> DataFrame:
    """(feature_id, center, scale) for kind ∈ {standard, robust, minmax}.

    standard: mean, population std (zero → 1); robust: median, IQR (zero → 1)
    from exact interpolated quartiles; minmax: min, max − min (zero → 1).  NULL and
    NaN cells are skipped.
    """
    long = long.withColumn(value, F.when(~F.isnan(value), F.col(value)))
    if kind == "standard":
        c = long.groupBy(feature).agg(F.avg(value).alias("center"),
                                      F.stddev_pop(value).alias("scale"))
    elif kind == "robust":
        q = feature_quartiles(long, feature, value, key)
        c = q.select(feature, F.col("median").alias("center"),
                     (F.col("p75") - F.col("p25")).alias("scale"))
    elif kind == "minmax":
        c = long.groupBy(feature).agg(F.min(value).alias("center"),
                                      (F.max(value) - F.min(value)).alias("scale"))
    else:
        raise ValueError(kind)
    return c.withColumn("scale", F.when(F.col("scale") == 0, F.lit(1.0)).otherwise(F.col("scale")))


def scale(long: DataFrame, constants: DataFrame, feature: str = "feature_id",
          value: str = "value", out: str = "scaled") -> DataFrame:
    """(x − center)/scale with the per-feature constants broadcast."""
    j = long.join(F.broadcast(constants.select(feature, "center", "scale")), feature)
    return j.withColumn(out, (F.col(value) - F.col("center")) / F.col("scale")) \
        .drop("center", "scale")


def impute_median(long: DataFrame, feature: str = "feature_id", value: str = "value",
                  key: str = "row_id") -> DataFrame:
    """M3: replace NULL/NaN by the feature's exact median (only where missing)."""
    med = feature_quartiles(long, feature, value, key).select(feature, "median")
    j = long.join(F.broadcast(med), feature)
    v = F.col(value)
    return j.withColumn(value, F.when(v.isNull() | F.isnan(v), F.col("median")).otherwise(v)) \
        .drop("median")


def check_scaling(scaled: DataFrame, manual: DataFrame, key: str = "row_id",
                  feature: str = "feature_id", a: str = "scaled", b: str = "manual") -> DataFrame:
    """Mean and max |scaled − manual| over matching cells."""
    j = scaled.select(key, feature, a).join(manual.select(key, feature, b), [key, feature])
    d = F.abs(F.col(a) - F.col(b))
    return j.agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 F.round(F.avg(d), 9).alias("mean_abs_diff"),
                 F.round(F.max(d), 9).alias("max_abs_diff"))


def prep_constants(long: DataFrame, scores: DataFrame | None = None, var_threshold: float = 0.0,
                   feature: str = "feature_id", value: str = "value") -> DataFrame:
    """(feature_id, keep, center, scale, variance, importance) in one table."""
    v = F.when(~F.isnan(value), F.col(value))   # NULL and NaN cells are skipped
    st = long.groupBy(feature).agg(
        F.avg(v).alias("center"), F.stddev_pop(v).alias("std"),
        F.var_pop(v).alias("variance"))
    t = st.select(feature, (F.col("variance") > var_threshold).alias("keep"),
                  F.round("center", 6).alias("center"),
                  F.round(F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")), 6).alias("scale"),
                  F.round("variance", 6).alias("variance"))
    if scores is not None:
        t = t.join(scores.select(feature, F.round("score", 6).alias("importance")), feature, "left")
    return t
