"""Registry of named queries: a Spark builder and, where one exists, DuckDB SQL.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
driver tables.  The SQL text (if any) is the independent oracle that computes
the same columns on the same parquet files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (  # noqa: F401
        q_foundation, q_stats, q_select, q_service, q_linear, q_models, q_search, q_transform,
        q_extra, q_boosting, q_wide, q_trials, q_mutual,
    )
