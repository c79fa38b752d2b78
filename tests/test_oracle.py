"""Every registered query with SQL must equal DuckDB on the same parquet files."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from thermoscope.sources.tables import TABLES

from conftest import SF_SMALL

SQL = entry.oracle_sql()
QUERIES = entry.queries()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return v


def _rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    return sorted((tuple(str(_norm(r[c])) for c in cols) for r in df[cols].to_dict("records")))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs_and_has_stable_schema(spark, name):
    # rows-only queries: run once at the smallest scale
    df = QUERIES[name](spark, SF_SMALL)
    assert len(df.columns) > 0
    assert df.count() >= 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert {r["split"] for r in rows} <= {"train", "test", "holdout"}
    assert all(r["r2"] <= 1.0 for r in rows)
