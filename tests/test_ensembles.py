"""Extra trees against a plain build from the same draws, and what they store."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermoscope.operators import ensembles as en


def _draw(tree, node, f, seed, depth):
    return int(hashlib.md5(f"{tree}:{node}:{f}:{seed}:et:{depth}".encode()).hexdigest()[:8], 16) / 4294967296.0


def _plain(x, y, tree, max_depth, least, seed):
    """{heap number: (feature, threshold) or leaf value} of one tree."""
    out, todo = {}, [(0, 0, np.arange(len(y)))]
    while todo:
        node, depth, rows = todo.pop()
        best = None
        for f in range(x.shape[1] if depth < max_depth and len(rows) >= least else 0):
            v = x[rows, f]
            known = v[~np.isnan(v)]
            if not len(known) or known.max() <= known.min():
                continue
            t = known.min() + _draw(tree, node, f, seed, depth) * (known.max() - known.min())
            left = v <= t
            if not 0 < left.sum() < len(rows):
                continue
            sse = lambda a: (a * a).sum() - a.sum() ** 2 / len(a)
            gain = sse(y[rows]) - sse(y[rows[left]]) - sse(y[rows[~left]])
            if gain > 0 and (best is None or gain > best[0]):
                best = gain, f, t, left
        if best is None:
            out[node] = y[rows].mean()
        else:
            out[node] = best[1:3]
            todo += [(2 * node + 1, depth + 1, rows[best[3]]), (2 * node + 2, depth + 1, rows[~best[3]])]
    return out


def _heaps(nodes):
    """{tree: {heap number: (feature, threshold) or leaf value}} of a node table."""
    out = {}
    for tree, g in nodes.toPandas().groupby("tree_id"):
        g, todo, found = g.set_index("node_id"), [(0, 0)], {}
        while todo:
            i, h = todo.pop()
            r = g.loc[i]
            if r["is_leaf"]:
                found[h] = float(r["value"])
            else:
                found[h] = int(r["feature"]), float(r["threshold"])
                todo += [(int(r["left"]), 2 * h + 1), (int(r["right"]), 2 * h + 2)]
        assert len(found) == len(g)
        out[int(tree)] = found
    return out


@pytest.mark.parametrize("cells", [1 << 20, 7])
def test_extra_trees_equal_a_plain_build(spark, monkeypatch, cells):
    monkeypatch.setattr(en, "SLICE_CELLS", cells, raising=False)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, (300, 3)).astype(float)
    x[rng.random(300) < 0.1, 1] = np.nan
    y = np.round(x[:, 0] * 3 - np.nan_to_num(x[:, 1]) + rng.integers(0, 5, 300))
    rows = [(i, [None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id long, f array<double>, y double").repartition(3)
    depth, trees = (4, 4) if cells > 7 else (3, 2)
    nodes = en.extra_trees(df, "f", "y", n_trees=trees, max_depth=depth, min_samples_split=5, seed=9)
    found = _heaps(nodes)
    assert sorted(found) == list(range(trees))
    for t in range(trees):
        want = _plain(x, y, t, depth, 5, 9)
        assert found[t].keys() == want.keys()
        for h, v in want.items():
            assert found[t][h] == pytest.approx(v)


def test_extra_trees_store_each_row_once(spark, monkeypatch):
    """Trees and levels walk over one stored copy of the rows (one copy a tree and level before)."""
    stored, store = [], en.materialize

    def counted(df):
        out = store(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(en, "materialize", counted)
    df = spark.range(200).selectExpr("id AS row_id", "array(double(id % 17), double(id % 5)) AS f", "double(id % 17) AS y")
    nodes = en.extra_trees(df, "f", "y", n_trees=6, max_depth=3)
    assert nodes.select("tree_id").distinct().count() == 6
    assert sum(stored) <= 200


def test_extra_trees_on_one_value_are_leaves(spark):
    df = spark.createDataFrame([(1, [2.0], 5.0), (2, [2.0], 7.0), (3, None, 6.0), (4, [2.0], None)],
                               "row_id long, f array<double>, y double")
    nodes = en.extra_trees(df, "f", "y", n_trees=2, max_depth=3).collect()
    assert [(r["tree_id"], r["is_leaf"], r["value"], r["weight"]) for r in nodes] == [(0, True, 6.0, 0.5), (1, True, 6.0, 0.5)]


def _weighted_rounds(df, features, y, rounds, rate):
    """AdaBoost.R2 with MLlib's own trees: (prediction of every round by row, estimator weights)."""
    from pyspark.ml.regression import DecisionTreeRegressor
    from thermoscope.operators.trees import assemble
    pdf = assemble(df.select("row_id", *features, y), features).toPandas().sort_values("row_id")
    pdf["w"] = 1.0 / len(pdf)
    each, weights = [], []
    for m in range(rounds):
        data = df.sparkSession.createDataFrame(pdf)
        fitted = DecisionTreeRegressor(featuresCol="features_vec", labelCol=y, weightCol="w", maxDepth=3, seed=42 + m).fit(data)
        p = fitted.transform(data).toPandas().sort_values("row_id")["prediction"].to_numpy()
        err = np.abs(pdf[y].to_numpy() - p)
        loss = (pdf["w"] * err).sum() / (err.max() * pdf["w"].sum())
        if loss >= 0.5:
            break
        beta = loss / (1 - loss)
        each.append(p)
        weights.append(rate * np.log(1 / beta))
        pdf["w"] = pdf["w"] / pdf["w"].sum() * beta ** ((1 - err / err.max()) * rate)
    return np.column_stack(each), np.array(weights)


def test_ada_rounds_equal_mllib_trees_in_few_jobs(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(512, 3))   # 16 rows a bin: no step of weight ends half-way between rows, where rounding decides
    x[:, 2] = np.round(x[:, 2])   # few values, zeros among them
    y = 3 * x[:, 0] + np.where(x[:, 2] > 0, 5.0, -1.0) * x[:, 1] + rng.normal(size=512)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "row_id long, a double, b double, c double, y double")
    rounds = 12   # more than KEPT_ROUNDS, so rows are rewritten once
    sc = spark.sparkContext
    sc.setJobGroup("ada-rounds", "")
    models, weights = en.ada_boost_r2(df, ["a", "b", "c"], "y", rounds, 1.2)
    jobs = len(sc.statusTracker().getJobIdsForGroup("ada-rounds"))
    sc.setJobGroup("other", "")
    each, expected = _weighted_rounds(df, ["a", "b", "c"], "y", rounds, 1.2)
    assert len(models) == each.shape[1] > en.KEPT_ROUNDS
    np.testing.assert_allclose(weights, expected, rtol=1e-9)
    for m, tree in enumerate(models):
        np.testing.assert_allclose(en._leaf(x, tree), each[:, m], rtol=1e-9)
    assert jobs <= 4 * len(models) + 8   # three levels and the errors; before, about ten a round

    nodes = spark.createDataFrame(en.ada_nodes(models, weights))
    p = np.column_stack([en._leaf(x, t) for t in models])
    walked = en.ensemble_predict(df.select("row_id", F.array("a", "b", "c").alias("features")), nodes).toPandas()
    np.testing.assert_allclose(walked.sort_values("row_id")["prediction"], p @ np.array(weights), rtol=1e-9)


def test_ada_draws_its_threshold_rows_by_key(spark):
    """More rows than a sample: same models whatever the partitions, about SAMPLE_ROWS rows drawn, anew in each round."""
    n = 30_000
    df = spark.range(n).select(F.col("id").alias("row_id"), (F.xxhash64("id") % 1000 / 7.0).alias("a"),
                               F.sin("id").alias("b")).withColumn("y", F.col("a") * F.col("b"))
    got = [en.ada_boost_r2(df.repartition(k), ["a", "b"], "y", 3) for k in (2, 7)]
    for (ma, wa), (mb, wb) in [got]:
        np.testing.assert_allclose(wa, wb, rtol=1e-9)
        for s, t in zip(ma, mb):
            np.testing.assert_array_equal(s[0], t[0])
            np.testing.assert_allclose(s[1], t[1])
    u = np.arange(n).astype(np.int64) * 7919
    a, b = (en._uniform(u, s) < en.SAMPLE_ROWS / n for s in (1, 2))
    assert abs(a.sum() - en.SAMPLE_ROWS) < 500 and (a & b).sum() < 0.45 * en.SAMPLE_ROWS


def test_ada_trees_from_one_pass(spark, monkeypatch):
    """With few features a round takes two jobs (four before); its trees are those of a pass for each level."""
    rng = np.random.default_rng(11)
    n = 3000
    x = np.column_stack([rng.normal(size=n), np.round(rng.normal(size=n)), rng.exponential(size=n)])
    x[::17, 0] = np.nan
    y = np.nan_to_num(x[:, 0]) * x[:, 1] + np.where(x[:, 2] > 1, 4.0, x[:, 2] ** 2) + rng.normal(size=n) * 0.3
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "row_id long, a double, b double, c double, y double").repartition(5)
    rounds, got, jobs = 10, [], []
    sc = spark.sparkContext
    for cells, partial in ((en.JOINT_CELLS, en.PARTIAL_BYTES), (en.JOINT_CELLS, 0), (0, en.PARTIAL_BYTES)):
        monkeypatch.setattr(en, "JOINT_CELLS", cells)
        monkeypatch.setattr(en, "PARTIAL_BYTES", partial)
        sc.setJobGroup(f"ada-{len(got)}", "")
        got.append(en.ada_boost_r2(df, ["a", "b", "c"], "y", rounds, 1.1))
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"ada-{len(got) - 1}")))
    sc.setJobGroup("other", "")
    for models, weights in got[:2]:
        assert len(models) == len(got[2][0]) == rounds
        np.testing.assert_allclose(weights, got[2][1], rtol=1e-9)
        for s, t in zip(models, got[2][0]):
            np.testing.assert_array_equal(s[0], t[0])
            np.testing.assert_allclose(s[1], t[1])
            np.testing.assert_allclose(s[2], t[2], rtol=1e-9)
    assert jobs[0] <= 2 * rounds + 8 < jobs[2]
