"""Portable, seeded row hashing.

Splits and folds must be reproducible on any engine (the DuckDB oracle
recomputes them), so membership comes from md5 of ``key:salt`` rather than
``rand()``/``xxhash64``.  The first 8 hex digits give a uniform 32-bit
integer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(key: Column | str, salt: str) -> Column:
    """Unsigned 32-bit integer from md5(key || ':' || salt)."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(k.cast("string"), F.lit(f":{salt}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_bucket(key: Column | str, salt: str, buckets: int) -> Column:
    return F.pmod(hash32(key, salt), F.lit(buckets)).cast("int")


def hash_unit(key: Column | str, salt: str) -> Column:
    """Uniform draw in [0, 1) that both engines reproduce."""
    return hash32(key, salt) / F.lit(4294967296.0)


def sql_hash32(expr: str, salt: str) -> str:
    """DuckDB text of :func:`hash32`."""
    return f"('0x' || substr(md5(CAST({expr} AS VARCHAR) || ':{salt}'), 1, 8))::BIGINT"


def sql_hash_bucket(expr: str, salt: str, buckets: int) -> str:
    return f"CAST({sql_hash32(expr, salt)} % {buckets} AS INTEGER)"
