"""Fits moved together against MLlib's own, one by one."""

import numpy as np
import pandas as pd

from thermoscope.operators import outliers as ol


def test_fits_move_together_and_equal_mllib(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) + rng.integers(0, 3, (300, 1)) * 2.0 + 50
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(300), "features": [list(map(float, r)) for r in x]}))
    vec = ol.to_vector(df).repartition(3).cache()
    seen, lloyd = [], ol.lloyd

    def kept(*args, **kwargs):
        seen.append(len(args[2]))
        return lloyd(*args, **kwargs)

    monkeypatch.setattr(ol, "lloyd", kept)
    got = ol.best_kmeans(vec, 3, n_init=4)
    fits = [KMeans(k=3, seed=42 + i, featuresCol="features_vec", maxIter=300, tol=1e-4).fit(vec) for i in range(4)]
    want = min(fits, key=lambda m: m.summary.trainingCost)
    # seeds that reach the same optimum may number it differently
    as_theirs = {i: int(((np.array(want.clusterCenters()) - c) ** 2).sum(1).argmin()) for i, c in enumerate(got.clusterCenters())}
    assert sorted(as_theirs.values()) == [0, 1, 2]
    for i, j in as_theirs.items():
        assert np.allclose(got.clusterCenters()[i], want.clusterCenters()[j], atol=1e-3)
    assert abs(got.cost - want.summary.trainingCost) < 1e-4 * got.cost
    labels = got.transform(vec).select("row_id", "cluster").toPandas().set_index("row_id")["cluster"].map(as_theirs)
    theirs = want.transform(vec).select("row_id", "prediction").toPandas().set_index("row_id")["prediction"]
    assert labels.sort_index().tolist() == theirs.sort_index().tolist()
    assert seen == [4]
    seen.clear()
    chosen = ol.choose_k(df, ks=(2, 3, 4), folds=3, n_init=2).toPandas()
    assert seen == [18] and (chosen["n_folds"] == 3).all()
