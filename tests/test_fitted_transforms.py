"""Transforms fitted on one table and applied to another."""

import numpy as np
import pandas as pd
import pytest

from thermoscope.operators import transforms as tf


def long_of(spark, columns):
    return spark.createDataFrame(pd.DataFrame([(f, i, float(v)) for f, c in enumerate(columns) for i, v in enumerate(c)],
                                              columns=["feature_id", "row_id", "value"])).repartition(3)


def likelihood(x, lam):
    with np.errstate(all="ignore"):
        pos = np.log1p(x) if abs(lam) < 1e-12 else ((x + 1) ** lam - 1) / lam
        neg = -np.log1p(-x) if abs(lam - 2) < 1e-12 else -((1 - x) ** (2 - lam) - 1) / (2 - lam)
    t = np.where(x >= 0, pos, neg)
    return -len(x) / 2 * np.log(t.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum(), t


def test_lambda_to_many_digits_and_beyond_the_first_bracket(spark):
    rng = np.random.default_rng(2)
    columns = [rng.normal(size=300) ** 3, np.exp(rng.normal(size=300)), 20 - rng.gamma(0.3, 1, 300) ** 0.3 * 3, np.ones(300),
               -np.exp(rng.normal(size=300) * 2)]
    fit = {r["feature_id"]: r for r in tf.fit_yeo_johnson(long_of(spark, columns)).collect()}
    for f, x in enumerate(columns):
        lam = fit[f]["lambda"]
        if f == 3:
            assert lam == 1.0 and fit[f]["scale"] == 1.0
            continue
        best, t = likelihood(x, lam)
        assert all(best >= likelihood(x, lam + d)[0] - 1e-9 for d in (-0.5, -1e-2, -1e-4, 1e-4, 1e-2, 0.5)), f
        assert fit[f]["center"] == pytest.approx(t.mean()) and fit[f]["scale"] == pytest.approx(t.std())
    assert max(abs(fit[f]["lambda"]) for f in fit) > 2
    new = tf.apply_yeo_johnson(long_of(spark, [[0.5, -0.5]]), tf.fit_yeo_johnson(long_of(spark, columns[:1])))
    got = {r["row_id"]: r["transformed"] for r in new.collect()}
    r = fit[0]
    assert got[0] == pytest.approx(((1.5 ** r["lambda"] - 1) / r["lambda"] - r["center"]) / r["scale"])


def test_quantiles_map_new_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    columns = [rng.normal(size=200), np.repeat([1.0, 2.0, 3.0, 4.0], 50), rng.normal(size=200)]
    fit = tf.fit_quantiles(long_of(spark, columns), 11)
    new = [[-99.0, 99.0, float(np.quantile(columns[0], 0.5))], [0.0, 2.0, 3.5], [float(np.quantile(columns[2], 0.25)), 0.0, 0.0]]
    want = {(0, 0): 0.0, (0, 1): 1.0, (0, 2): 0.5, (1, 0): 0.0}
    for limit in (tf.TABLE_NUMBERS, 11):   # one group of features, or one feature at a time
        monkeypatch.setattr(tf, "TABLE_NUMBERS", limit)
        got = {(r["feature_id"], r["row_id"]): r["quantile"] for r in tf.apply_quantiles(long_of(spark, new), fit).collect()}
        assert len(got) == 9 and all(got[k] == pytest.approx(v) for k, v in want.items())
        q = np.quantile(columns[1], np.linspace(0, 1, 11))
        at = np.flatnonzero(q == 2.0)
        assert got[1, 1] == pytest.approx((at[0] + at[-1]) / 20)
    nulls = spark.createDataFrame([(0, 1, None), (7, 2, 1.0)], "feature_id long, row_id long, value double")
    assert [r["quantile"] for r in tf.apply_quantiles(nulls, fit).collect()] == [None]
