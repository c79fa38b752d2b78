"""Wide SVD and PCA against NumPy."""

import numpy as np
import pandas as pd
import pytest

from thermoscope.operators import wide
from thermoscope.operators.decompose import project


def table_of(spark, x, parts=3):
    return spark.createDataFrame(pd.DataFrame({"row_id": range(len(x)), "features": [list(map(float, r)) for r in x],
                                               "m": "x"})).repartition(parts)


def test_singular_values_and_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 30)) * np.linspace(3, 0.2, 30) + 50
    df = table_of(spark, x)
    fit = wide.svd(df, "features", 5, block_cols=7)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(fit["singular_values"], s[:5], rtol=1e-9)
    assert np.allclose(np.abs((fit["components"] * vt[:5].T).sum(0)), 1, atol=1e-8)
    p = wide.pca(df, "features", 4, block_cols=7)
    c = x - x.mean(0)
    s = np.linalg.svd(c, compute_uv=False)
    assert np.allclose(p["explained_variance"], s[:4] ** 2 / 89, rtol=1e-9)
    assert np.allclose(p["ratio"], s[:4] ** 2 / (s ** 2).sum(), rtol=1e-9)
    got = project(df, "features", p).toPandas().set_index("row_id").sort_index()["components"]
    assert np.allclose(np.stack(got), c @ p["components"], atol=1e-8)


def test_wider_than_tall_and_low_rank(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 3000))
    fit = wide.svd(table_of(spark, x), "features", 6)
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(fit["singular_values"][:3], s[:3], rtol=1e-9)
    assert fit["singular_values"][3:].max(initial=0) < 1e-8 * s[0] and fit["passes"] <= 4


def test_update_equals_one_fit(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 12)) + 7
    x[30:] += 2
    whole = wide.pca(table_of(spark, x), "features", 12)
    part = wide.update(wide.pca(table_of(spark, x[:30]), "features", 12), table_of(spark, x[30:]), "features", block_cols=5)
    assert np.allclose(part["explained_variance"], whole["explained_variance"], rtol=1e-8)
    assert np.allclose(part["mean"], whole["mean"]) and part["n"] == 60
    assert np.allclose(part["ratio"], whole["ratio"], rtol=1e-8)


def test_bad_rows_raise(spark):
    bad = spark.createDataFrame([([1.0, None],), ([1.0, 2.0],)], "features array<double>")
    with pytest.raises(Exception, match="impute|every feature"):
        wide.svd(bad, "features", 1)
    with pytest.raises(ValueError):
        wide.svd(bad.where("size(features) > 5"), "features", 1)
