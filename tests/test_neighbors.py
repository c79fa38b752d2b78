"""Tree of pivots against all pairs."""

import numpy as np
import pandas as pd
import pytest

from thermoscope.operators import neighbors as nn


def table_of(spark, x, ids=None):
    return spark.createDataFrame(pd.DataFrame({"row_id": np.arange(len(x)) if ids is None else ids,
                                               "features": [list(map(float, r)) for r in x], "q": "x"})).repartition(4)


def brute(x, ids, k):
    out = {}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = sorted((d[j], ids[j]) for j in range(len(x)) if j != i)[:k]
        out[int(ids[i])] = order
    return out


def check(got, x, ids, k):
    want = brute(x, ids, k)
    found = {}
    for r in got.collect():
        found.setdefault(r["row_id"], {})[r["rank"]] = (r["dist"], r["neighbor"])
    assert set(found) == set(want)
    for i, rows in found.items():
        assert [rows[j][1] for j in sorted(rows)] == [b for _, b in want[i]], i
        assert np.allclose([rows[j][0] for j in sorted(rows)], [a for a, _ in want[i]], atol=1e-9)


@pytest.mark.parametrize("small_broadcast", [False, True])
def test_exact_with_copies_and_ties(spark, monkeypatch, small_broadcast):
    if small_broadcast:
        monkeypatch.setattr(nn, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(1)
    x = np.vstack((rng.normal(size=(260, 3)), np.zeros((60, 3)), rng.integers(0, 3, (60, 3)), rng.normal(size=(60, 3)) * 0.01 + 9))
    x = np.round(x, 3) + 1000
    ids = rng.permutation(len(x)) * 7
    report = {}
    check(nn.knn(table_of(spark, x, ids), 5, leaf=40, report=report), x, ids, 5)
    assert report["levels"] >= 1 and report["largest"] <= 40 and report["entries"] < len(x)


def test_small_tables(spark):
    x = np.array([[0.0, 0], [1, 0], [1, 0]])
    check(nn.knn(table_of(spark, x), 2), x, np.arange(3), 2)
    assert nn.knn(table_of(spark, x).where("row_id < 0"), 2).count() == 0
    assert nn.knn(table_of(spark, x[:1]), 2).count() == 0


def test_comparisons_grow_slowly(spark):
    """Rows in clusters: four times the rows cost far less than four times the comparisons of each."""
    cost = []
    for n in (2000, 8000):
        rng = np.random.default_rng(2)
        x = rng.normal(size=(n, 2)) * 0.1 + rng.integers(0, 30, (n, 2))
        report = {}
        nn.knn(table_of(spark, x), 3, leaf=100, report=report).count()
        assert report["largest"] <= 100
        cost.append(report["comparisons"])
    assert cost[1] < 2 * cost[0] and cost[1] < 8000 / 8


def test_wide_rows_are_sent_once_a_leaf(spark, monkeypatch):
    """64 coordinates rule nothing out: every query meets every leaf, so leaves must be full ones, not hundreds of small."""
    seen, search = [], nn._leaf_search

    def kept(tree, *args):
        visits = args[-2]
        seen.append((visits.groupBy("q").count().agg({"count": "max"}).first()[0], "x" in visits.columns))
        return search(tree, *args)

    monkeypatch.setattr(nn, "_leaf_search", kept)
    x = np.random.default_rng(3).normal(size=(900, 64))
    check(nn.knn(table_of(spark, x), 4, leaf=300), x, np.arange(900), 4)
    most, carries = seen[0]
    assert most <= 6 and not carries


def test_search_inside_a_group_stays_near():
    """A dense cloud of two coordinates: a row is compared to a few boxes of its group."""
    rng = np.random.default_rng(4)
    x, met, dist = rng.normal(size=(8000, 2)), [0], nn._dist

    def counted(a, b, metric):
        met[0] += len(a) * len(b)
        return dist(a, b, metric)

    nn._dist = counted
    try:
        got = nn._nearest(x, np.arange(8000), x, np.arange(8000), 3, "chebyshev")
    finally:
        nn._dist = dist
    assert met[0] < 8000 * 1000
    for i in (0, 11, 4000):
        d = np.abs(x - x[got["q"].iloc[i]]).max(1)
        d[got["q"].iloc[i]] = np.inf
        assert list(got["nb"].iloc[i]) == list(np.argsort(d, kind="stable")[:3])
