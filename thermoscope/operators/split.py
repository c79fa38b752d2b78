"""Reproducible splits and folds.

Membership is a pure function of the row key and a seed, so every executor
computes it locally (no shuffle, no driver state), a lost task recomputes the
same rows, and the DuckDB oracle recomputes the same buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, sql_hash_bucket
from .ranking import ntile_of, ranked

# The reference's split proportions and seed.
TRAIN_TEST_HOLDOUT = (("train", 8), ("test", 1), ("holdout", 1))   # tenths, seed 42
NAMED_SPLITS = (("test", 20), ("validation", 15), ("holdout", 10))  # percent; train = rest
SEED = 42


def _cut_expr(bucket, cuts: Sequence[tuple[str, int]], rest: str | None):
    expr, lo = None, 0
    for name, width in cuts:
        cond = (bucket >= lo) & (bucket < lo + width)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
        lo += width
    return expr.otherwise(F.lit(rest)) if rest else expr


def split(df: DataFrame, key: str = "row_id", cuts=TRAIN_TEST_HOLDOUT,
          seed: int = SEED, name: str = "split") -> DataFrame:
    """80/10/10 train/test/holdout by md5 bucket mod 10 (M1)."""
    total = sum(w for _, w in cuts)
    return df.withColumn(name, _cut_expr(hash_bucket(key, str(seed), total), cuts, None))


def sql_split(key: str = "row_id", cuts=TRAIN_TEST_HOLDOUT, seed: int = SEED) -> str:
    total = sum(w for _, w in cuts)
    b = sql_hash_bucket(key, str(seed), total)
    parts, lo = [], 0
    for name, width in cuts:
        parts.append(f"WHEN {b} >= {lo} AND {b} < {lo + width} THEN '{name}'")
        lo += width
    return "CASE " + " ".join(parts) + " END"


def split_named(df: DataFrame, key: str = "row_id", cuts=NAMED_SPLITS,
                seed: int = SEED, name: str = "split") -> DataFrame:
    """Four-way train/test/validation/holdout split by md5 bucket mod 100."""
    return df.withColumn(name, _cut_expr(hash_bucket(key, str(seed), 100), cuts, "train"))


def sql_split_named(key: str = "row_id", cuts=NAMED_SPLITS, seed: int = SEED) -> str:
    b = sql_hash_bucket(key, str(seed), 100)
    parts, lo = [], 0
    for name, width in cuts:
        parts.append(f"WHEN {b} >= {lo} AND {b} < {lo + width} THEN '{name}'")
        lo += width
    return "CASE " + " ".join(parts) + " ELSE 'train' END"


def folds(df: DataFrame, key: str = "row_id", k: int = 5, repeats: int = 3,
          seed: int = SEED) -> DataFrame:
    """Shuffled repeated k-fold (M2/W7): one row per (row, repeat) with ``fold``.

    The repeat dimension is generated per row (explode of a fixed-size
    sequence), not joined, so the data is read once.
    """
    out = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    salt = F.concat(F.col(key).cast("string"), F.lit(f":{seed}:"), F.col("repeat").cast("string"))
    return out.withColumn("fold", hash_bucket(salt, "fold", k))


def sql_fold(key: str, repeat_expr: str, k: int, seed: int = SEED) -> str:
    inner = f"CAST({key} AS VARCHAR) || ':{seed}:' || CAST({repeat_expr} AS VARCHAR)"
    return sql_hash_bucket(inner, "fold", k)


def contiguous_folds(df: DataFrame, key: str = "row_id", k: int = 3) -> DataFrame:
    """Unshuffled k folds in key order, sizes as SQL ``ntile``."""
    r = ranked(df, [key], name="__rn", count_name="__n")
    return r.withColumn("fold", ntile_of("__rn", "__n", k) - 1).drop("__rn", "__n")


def check_splits(df: DataFrame, key: str = "row_id", split_col: str = "split") -> DataFrame:
    """One row proving the splits partition the keys.

    ``n_rows`` = rows, ``n_keys`` = distinct keys, ``n_multi`` = keys that
    landed in more than one split (must be 0), ``n_unassigned`` = rows with no
    split (must be 0).
    """
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(split_col).alias("splits"),
        F.count_if(F.col(split_col).isNull()).alias("nulls"))
    return per_key.agg(
        F.sum("rows").cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).cast("bigint").alias("n_keys"),
        F.count_if(F.col("splits") > 1).cast("bigint").alias("n_multi"),
        F.sum("nulls").cast("bigint").alias("n_unassigned"))


def write_splits(df: DataFrame, path: str, split_col: str = "split", fmt: str = "parquet") -> None:
    """One directory per split; readers prune by ``split=...``."""
    (df.write.mode("overwrite").partitionBy(split_col).format(fmt)
       .option("header", "true").save(path))
