"""Fast Gauss transform against the sum over all pairs."""

import math

import numpy as np
import pandas as pd
import pytest

from thermoscope.operators import gauss
from thermoscope.operators.kernel import hsic_exact_numpy


def long_of(spark, columns, y, fid="feature_id"):
    n = len(y)
    return spark.createDataFrame(pd.DataFrame({
        "row_id": np.tile(np.arange(n), len(columns)), fid: np.repeat(np.arange(len(columns)), n),
        "value": np.concatenate(columns), "y": np.tile(y, len(columns)), "m": "x"})).repartition(3)


@pytest.mark.parametrize("gamma", [0.02, 1.0, 40.0])
def test_equals_all_pairs(spark, gamma):
    rng = np.random.default_rng(int(gamma * 100))
    n = 150
    x = [rng.normal(size=n), rng.normal(size=n) * 30 - 500, np.round(rng.normal(size=n)), np.zeros(n)]
    y = np.where(rng.random(n) < 0.5, np.sin(x[0]), rng.normal(size=n) * 20)
    got = {r["feature_id"]: r["score"] for r in gauss.hsic(long_of(spark, x, y), gamma).collect()}
    for f, c in enumerate(x):
        assert got[f] == pytest.approx(hsic_exact_numpy(c, y, gamma), abs=20 * gauss.error_bound())
    assert gauss.error_bound() < 1e-10


def test_one_kernel_value_is_within_the_bound():
    rng = np.random.default_rng(1)
    h = gauss.SIDE / math.sqrt(2.0)
    a, b = rng.integers(-30, 30, 200), rng.integers(-30, 30, 200)
    u, v = rng.uniform(-h / 2, h / 2, 200), rng.uniform(-h / 2, h / 2, 200)
    u[:20], v[:20] = h / 2, -h / 2
    k = np.arange(gauss.ORDER)
    for i in range(200):
        t = gauss._coupling(a[i:i + 1], b[i:i + 1], 1.0)[0, :, 0, :]
        exact = math.exp(-((a[i] - b[i]) * h + u[i] - v[i]) ** 2)
        assert abs(u[i] ** k @ t @ v[i] ** k - exact) <= gauss.error_bound()


def test_missing_values_and_small_groups(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, None, 2.0), (0, float("nan"), 1.0), (0, 2.0, None), (1, 1.0, 1.0), (1, 3.0, 2.0),
                                (1, 2.0, 9.0)], "feature_id int, value double, y double")
    got = {r["feature_id"]: r for r in gauss.hsic(df).collect()}
    assert got[0]["n"] == 1 and got[0]["score"] is None
    assert got[1]["score"] == pytest.approx(hsic_exact_numpy(np.array([1.0, 3, 2]), np.array([1.0, 2, 9])), abs=1e-9)
    assert gauss.hsic(df.where("value > 100")).count() == 0
    with pytest.raises(ValueError):
        gauss.hsic(df, 0.0)
