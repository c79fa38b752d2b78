"""Leaf-wise boosting against a plain in-memory version."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from thermoscope.operators import boosting as bo
from thermoscope.operators.trees import ensemble_predict


def brute(x, y, keys, edges, rounds, lr, num_leaves, min_rows, l2, subsample, colsample, seed, max_depth=-1):
    """Predictions and (feature, bin) splits in order, by scanning every open leaf."""
    x = np.where(np.isnan(x), -np.inf, x)
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    pred, splits = np.full(len(y), y.mean()), []
    h = lambda k, s: int(hashlib.md5(f"{k}:{s}".encode()).hexdigest()[:8], 16)
    for r in range(rounds):
        inside = np.array([subsample >= 1 or h(k, f"{seed}:rows:{r}") < int(subsample * 2**32) for k in keys])
        cols = bo.sampled_columns(x.shape[1], colsample, seed, r)
        g = y - pred
        part = lambda m: g[m].sum() ** 2 / (m.sum() + l2)
        scale = max(sum(part2 for b in np.unique(bins[inside, f]) for part2 in
                        [g[inside & (bins[:, f] == b)].sum() ** 2 / (inside & (bins[:, f] == b)).sum()]) for f in cols)
        leaf, n_nodes, depth, tree = np.zeros(len(y), int), 1, {0: 0}, []
        while len(depth) < num_leaves:
            best = None
            for i in sorted(depth):
                if 0 <= max_depth <= depth[i]:
                    continue
                here = inside & (leaf == i)
                for f in cols:
                    for b in np.unique(bins[here, f]):
                        left, right = here & (bins[:, f] <= b), here & (bins[:, f] > b)
                        if left.sum() < min_rows or right.sum() < min_rows:
                            continue
                        gain = round((part(left) + part(right) - part(here)) / scale, 10)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, i, f, b)
            if best is None:
                break
            _, i, f, b = best
            tree.append((f, int(b)))
            here = leaf == i
            d = depth.pop(i)
            depth[n_nodes], depth[n_nodes + 1] = d + 1, d + 1
            leaf[here & (bins[:, f] <= b)], leaf[here & (bins[:, f] > b)] = n_nodes, n_nodes + 1
            n_nodes += 2
        splits.append(tree)
        for i in depth:
            m = inside & (leaf == i)
            if m.any():
                pred[leaf == i] += lr * g[m].sum() / (m.sum() + l2)
    return pred, splits


def table_of(spark, x, y):
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("features", T.ArrayType(T.DoubleType())),
                           T.StructField("y", T.DoubleType()), T.StructField("pred", T.StringType())])
    rows = [(i, [None if np.isnan(v) else float(v) for v in r], float(t), "x") for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("params", [
    dict(rounds=3, learning_rate=0.3, num_leaves=9, min_rows=5, l2=0.0, subsample=1.0, colsample=1.0),
    dict(rounds=11, learning_rate=0.2, num_leaves=3, min_rows=8, l2=1.0, subsample=0.7, colsample=0.6),
    dict(rounds=2, learning_rate=0.5, num_leaves=64, min_rows=3, l2=0.5, subsample=0.9, colsample=1.0, max_depth=3),
])
def test_equals_plain_version(spark, params):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(240, 4)).round(2)
    x[rng.random(240) < 0.05, 1] = np.nan
    x[:, 3] = rng.integers(0, 3, 240)
    y = np.round(np.nan_to_num(x[:, 0]) * 3 + (x[:, 3] == 1) * 2 + np.sin(2 * x[:, 2]) + rng.normal(size=240) * 0.1, 3)
    df = table_of(spark, x, y)
    model = bo.fit_boosting(df, "features", "y", max_bins=32, seed=5, **params)
    p = dict(params)
    want, splits = brute(x, y, range(240), model.edges, p["rounds"], p["learning_rate"], p["num_leaves"], p["min_rows"],
                         p["l2"], p["subsample"], p["colsample"], 5, p.get("max_depth", -1))
    got = [[(n.feature, n.bin) for n in sorted((n for n in t if n.split), key=lambda n: n.rank)] for t in model.trees]
    assert got == splits
    pred = {r["row_id"]: r["prediction"] for r in model.transform(df, "features").collect()}
    assert np.allclose([pred[i] for i in range(240)], want, atol=1e-9)
    filled = ~np.isnan(x).any(1)
    walked = {r["row_id"]: r["prediction"] for r in ensemble_predict(df, model.nodes(spark)).collect()}
    assert np.allclose([walked[i] for i in range(240) if filled[i]], want[filled], atol=1e-9)


def test_edges_of_the_model(spark):
    one = table_of(spark, np.ones((30, 2)), np.arange(30.0))
    model = bo.fit_boosting(one, "features", "y", rounds=2, min_rows=1)
    assert {r["prediction"] for r in model.transform(one, "features").collect()} == {14.5}
    empty = bo.fit_boosting(one.where("row_id < 0"), "features", "y", rounds=2)
    assert empty.trees == [] and empty.start == 0.0
    with pytest.raises(ValueError):
        bo.fit_boosting(one, "features", "y", max_bins=300)


def test_optional_boosters_as_trials(spark):
    from thermoscope.operators import search
    t = search.sample_trials(spark, 40, families=("xgb", "lgbm"))
    drawn = {r["model_type"]: r["params"] for r in t.collect()}
    assert "lgbm_num_leaves" in drawn["lgbm"] and 0.6 <= float(drawn["xgb"]["xgb_subsample"]) <= 1
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    df = table_of(spark, x, x[:, 0] * 2).selectExpr("row_id", "features[0] AS a", "features[1] AS b", "y", "row_id % 2 AS fold")
    trials = spark.createDataFrame([(0, "lgbm", {"lgbm_n_estimators": "4", "lgbm_num_leaves": "5", "lgbm_learning_rate": "0.5",
                                                 "scaler_type": "standard", "lgbm_colsample_bytree": "1.0"})],
                                   "trial int, model_type string, params map<string,string>")
    r = search.evaluate_trials(spark, df, ["a", "b"], "y", trials).first()
    assert r["state"] == "COMPLETE" and r["value"] > 0.5
