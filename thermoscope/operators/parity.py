"""Prediction parity between two predictors over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import parity_verdict, safe_corr
from .ranking import ranked

TOLERANCE = 0.5  # fixed value: ±0.5 target accuracy


def pair(a: DataFrame, b: DataFrame, key: str = "row_id", pa: str = "pred_a",
         pb: str = "pred_b") -> DataFrame:
    """The two predictions side by side (inner equi-join on the row key)."""
    return a.select(key, pa).join(b.select(key, pb), key, "inner") \
        .withColumn("abs_diff", F.abs(F.col(pa) - F.col(pb)))


def pair_columns(df: DataFrame, pa: str = "pred_a", pb: str = "pred_b") -> DataFrame:
    """Both predictions already on each row (one scoring pass): no join needed."""
    return df.withColumn("abs_diff", F.abs(F.col(pa) - F.col(pb)))


def parity(pairs: DataFrame, tol: float = TOLERANCE, pa: str = "pred_a", pb: str = "pred_b",
           strict: bool = False) -> DataFrame:
    """A10 + A11 + F3: one report row."""
    d = F.col("abs_diff")
    rep = pairs.agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.round(F.avg(d), 6).alias("mean_abs_diff"),
        F.round(F.stddev_pop(d), 6).alias("std_abs_diff"),
        F.round(F.max(d), 6).alias("max_abs_diff"),
        F.round(F.min(d), 6).alias("min_abs_diff"),
        F.count_if(d <= tol).cast("bigint").alias("n_within"),
        F.round(safe_corr(pa, pb), 6).alias("corr"))
    pct = F.round(F.col("n_within") * 100.0 / F.col("n"), 6)
    return rep.withColumn("pct_within", pct).withColumn("verdict", parity_verdict(pct, strict))


def accuracy_curve(pairs: DataFrame, key: str = "row_id") -> DataFrame:
    """Sorted |diff| with the cumulative share of rows at or below it.

    The global order comes from the skew-safe :func:`ranked`, so no single
    task sorts all rows.
    """
    r = ranked(pairs.select(key, "abs_diff"), ["abs_diff", key], name="k", count_name="__n")
    return r.select(key, F.col("k").cast("bigint").alias("k"), F.round("abs_diff", 6).alias("abs_diff"),
                    F.round(F.col("k") * 100.0 / F.col("__n"), 6).alias("cum_pct"))
