"""Nearest-neighbour mutual information against a plain version over all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermoscope.operators import mutual as mu


def psi(n):
    return -0.5772156649015329 + sum(1.0 / j for j in range(1, int(n)))


def plain(x, y, k=3):
    x, y = x / round(x.std(), 6), y / round(y.std(), 6)
    dx, dy = np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None])
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    e = np.sort(d, axis=1)[:, k - 1][:, None]
    nx, ny = ((dx < e) | (dx == 0)).sum(1), ((dy < e) | (dy == 0)).sum(1)
    return max(0.0, psi(len(x)) + psi(k) - np.mean([psi(a) + psi(b) for a, b in zip(nx, ny)]))


def test_equals_plain_version(spark):
    rng = np.random.default_rng(9)
    n = 220
    y = np.round(rng.normal(size=n) * 3)
    columns = [rng.normal(size=n), y + rng.normal(size=n) * 0.2, np.round(y * 0.5), rng.normal(size=n) * 1e5 + 1e7, np.ones(n),
               np.sin(y) * 1e-3]
    df = spark.createDataFrame(pd.DataFrame({"feature_id": np.repeat(np.arange(6), n), "value": np.concatenate(columns),
                                             "y": np.tile(y, 6), "e": "x"})).repartition(4)
    got = {r["feature_id"]: r["score"] for r in mu.knn_mi(df, leaf=200).collect()}
    for f, c in enumerate(columns):
        assert got[f] == pytest.approx(plain(c, y) if f != 4 else 0.0, abs=1e-9), f
    assert got[1] > 3 * got[0]


def test_ends_of_intervals():
    rng = np.random.default_rng(3)
    x, e = rng.normal(size=4000), np.abs(rng.normal(size=4000)) * rng.choice([1, 1e-9, 1e3], 4000)
    x[:500], e[:500] = 0.3, 0.3 + rng.normal(size=500) * 1e-8
    e[::7] = 0
    for up, sign in ((True, 1), (False, -1)):
        h = mu._ends(pd.Series(x), pd.Series(e), up).to_numpy()
        far = np.nextafter(h, sign * np.inf)
        assert (np.abs(h - x) < np.where(e > 0, e, 1)).all() and (np.abs(far - x)[e > 0] >= e[e > 0]).all()
        assert (h[e == 0] == x[e == 0]).all()


def test_digamma(spark):
    got = spark.range(1, 200).select("id", mu.digamma(F.col("id")).alias("v")).collect()
    assert all(r["v"] == pytest.approx(psi(r["id"]), abs=1e-11) for r in got)


def test_missing_and_short_features(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, None, 2.0), (0, 2.0, float("nan")), (0, 4.0, 1.0)],
                               "feature_id int, value double, y double")
    rows = mu.knn_mi(df).collect()
    assert [(r["feature_id"], r["n"], r["score"]) for r in rows] == [(0, 2, None)]
    assert mu.knn_mi(df.where("value > 50")).count() == 0


@pytest.mark.parametrize("values", [mu.VALUES, 0])
def test_targets_of_few_values(spark, monkeypatch, values):
    """Classes of unequal size and distance, ties, copies and outliers: by values, in pieces of few rows, and by the tree."""
    used, by = [], mu._reach_by_values
    monkeypatch.setattr(mu, "_reach_by_values", lambda *a: used.append(1) or by(*a))
    monkeypatch.setattr(mu, "VALUES", values)
    monkeypatch.setattr(mu, "PIECE", 60)
    monkeypatch.setattr(mu, "CHUNK", 7)
    rng = np.random.default_rng(5)
    n = 400
    y = rng.choice([0.0, 1.0, 1.01, 5.0, 9.0], n, p=[.5, .3, .1, .0925, .0075])
    columns = [rng.normal(size=n), y + rng.normal(size=n) * 0.2, np.round(rng.normal(size=n), 1), np.round(y * 0.5) + 0.0,
               rng.standard_cauchy(n), np.where(rng.random(n) < 0.4, 3.0, rng.normal(size=n) * 1e-3)]
    df = spark.createDataFrame(pd.DataFrame({"feature_id": np.repeat(np.arange(6), n), "value": np.concatenate(columns),
                                             "y": np.tile(y, 6)})).repartition(4)
    got = {r["feature_id"]: r["score"] for r in mu.knn_mi(df, leaf=200).collect()}
    for f, c in enumerate(columns):
        assert got[f] == pytest.approx(plain(c, y), abs=1e-9), f
    assert len(used) == (1 if values else 0)
