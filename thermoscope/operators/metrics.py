"""Regression metrics and diagnostic tables.

All metrics are ordinary grouped aggregates, so Spark computes partial
aggregates map-side and shuffles one small buffer per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r2_expr(sse: Column, sst: Column) -> Column:
    """1 − SSE/SST; a constant target scores 1.0 for an exact fit, else 0.0.

    Not ``regr_r2``: that is the squared correlation and ignores bias.
    """
    return F.when(sst > 0, F.lit(1.0) - sse / sst) \
        .when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def metric_aggs(y: str = "y", p: str = "prediction", digits: int = 6) -> list[Column]:
    err = F.col(y) - F.col(p)
    sse = F.sum(err * err)
    sst = F.var_pop(y) * F.count(y)
    return [
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.round(r2_expr(sse, sst), digits).alias("r2"),
        F.round(F.avg(F.abs(err)), digits).alias("mae"),
        F.round(F.avg(err * err), digits).alias("mse"),
        F.round(F.sqrt(F.avg(err * err)), digits).alias("rmse"),
    ]


def metrics(df: DataFrame, y: str = "y", p: str = "prediction",
            by: Sequence[str] = (), with_range: bool = False) -> DataFrame:
    """n, r2, mae, mse, rmse (+ prediction min/max/mean) per group."""
    aggs = metric_aggs(y, p)
    if with_range:
        aggs += [F.round(F.min(p), 6).alias("pred_min"),
                 F.round(F.max(p), 6).alias("pred_max"),
                 F.round(F.avg(p), 6).alias("pred_mean")]
    return df.groupBy(*by).agg(*aggs)


def residuals(df: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    """signed residual and absolute difference."""
    return df.withColumn("residual", F.col(y) - F.col(p)) \
             .withColumn("abs_diff", F.abs(F.col(y) - F.col(p)))


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram over [min, max]; the max lands in the last bin.

    Bounds come from one aggregate per group; rows are bucketed by a column
    expression and counted — no data is gathered anywhere.
    """
    bounds = df.groupBy(*by).agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    if by:
        # one row per group; AQE broadcasts it when the runtime size is small
        joined = df.join(bounds, on=list(by), how="inner")
    else:
        row = bounds.first()  # a single (min, max) pair
        joined = df.withColumn("__lo", F.lit(row["__lo"])).withColumn("__hi", F.lit(row["__hi"]))
    width = F.col("__hi") - F.col("__lo")
    b = F.when(width > 0, F.least(F.lit(bins - 1),
                                  F.floor((F.col(col) - F.col("__lo")) / width * bins))) \
        .otherwise(F.lit(0)).cast("int")
    out = joined.where(F.col(col).isNotNull()).withColumn("bin", b)
    return out.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).cast("bigint").alias("count"),
        F.round(F.first("__lo") + F.col("bin") * F.first(width) / bins, 6).alias("bin_lo"),
        F.round(F.first("__lo") + (F.col("bin") + 1) * F.first(width) / bins, 6).alias("bin_hi"))


def target_met(r2: Column | str, target: float) -> Column:
    """r2 reached the target."""
    c = F.col(r2) if isinstance(r2, str) else r2
    return c >= F.lit(target)
