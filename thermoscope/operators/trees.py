"""Tree regressors, node tables and routing.

Fitting uses MLlib's distributed tree learners.  A fitted model is exported
as a node table read back from the model's own saved parquet data (no
driver-side tree walk); rows are routed either level by level with joins
(SQL-shaped, for parity checks) or in one vectorised pass with the node table
broadcast (bounded by trees × 2^(depth+1) nodes, checked before broadcasting).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_NODES = 5_000_000
LITERAL_NODES = 50_000


def assemble(df: DataFrame, features: Sequence[str], out: str = "features_vec") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def fit_tree_model(df: DataFrame, features: Sequence[str], y: str, kind: str, **params):
    """kind ∈ {tree, forest, bagging, boosted}; params are MLlib parameter names."""
    from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor,
                                       RandomForestRegressor)
    vec = assemble(df, features)
    common = dict(featuresCol="features_vec", labelCol=y, seed=params.pop("seed", 42))
    if kind == "tree":
        est = DecisionTreeRegressor(**common, **params)
    elif kind == "forest":
        est = RandomForestRegressor(**common, featureSubsetStrategy=params.pop("featureSubsetStrategy", "all"),
                                    **params)
    elif kind == "bagging":
        # bagged full-feature trees: bootstrap rows, every split sees every feature
        est = RandomForestRegressor(**common, featureSubsetStrategy="all", bootstrap=True,
                                    maxDepth=params.pop("maxDepth", 30), **params)
    elif kind == "boosted":
        est = GBTRegressor(**common, **params)
    else:
        raise ValueError(kind)
    return est.fit(vec)


def tree_nodes(model, scratch_dir: str) -> DataFrame:
    """Node table (tree_id, node_id, feature, threshold, left, right, value, is_leaf, weight).

    Written by MLlib's own writer and read back as parquet; leaves carry
    feature −1.  Continuous splits go left when x[feature] ≤ threshold.
    """
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    path = f"{scratch_dir.rstrip('/')}/model-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "treeID" in data.columns:
        nodes = data.select(F.col("treeID").alias("tree_id"), F.col("nodeData.*"))
    else:
        nodes = data.select(F.lit(0).alias("tree_id"), "*")
    weights = None
    name = type(model).__name__
    if name.startswith("GBT"):
        w = list(model.treeWeights)
        weights = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "tree_id int, weight double")
    leaf = F.col("leftChild") < 0
    out = nodes.select(
        F.col("tree_id").cast("int"), F.col("id").cast("int").alias("node_id"),
        F.when(leaf, F.lit(-1)).otherwise(F.col("split.featureIndex")).cast("int").alias("feature"),
        F.when(leaf, F.lit(0.0)).otherwise(F.element_at("split.leftCategoriesOrThreshold", 1)).alias("threshold"),
        F.col("leftChild").cast("int").alias("left"), F.col("rightChild").cast("int").alias("right"),
        F.col("prediction").alias("value"), leaf.alias("is_leaf"))
    if weights is not None:
        out = out.join(F.broadcast(weights), "tree_id")
    else:
        n_trees = nodes.select("tree_id").distinct().count()
        out = out.withColumn("weight", F.lit(1.0 / n_trees))
    return out


def route(df: DataFrame, nodes: DataFrame, features: str = "features", key: str = "row_id",
          max_depth: int = 30) -> DataFrame:
    """Walk every row down every tree (``max_depth`` = the model's depth).

    Returns (row_id, tree_id, leaf value, weight).  Up to LITERAL_NODES nodes stand in the plan as arrays and
    a row walks in one expression, without a join; larger tables, bounded by the model size and checked, are
    broadcast into one join per level.
    """
    size = nodes.count()
    if size > MAX_BROADCAST_NODES:
        raise ValueError("node table too large to broadcast")
    if size <= LITERAL_NODES:
        return _route_in_row(df, _tree_arrays(nodes), features, key, max_depth)
    nb = F.broadcast(nodes.select(
        *[F.col(c).cast("int").alias(c) for c in ("tree_id", "node_id", "feature", "left", "right")],
        F.col("threshold").cast("double"), F.col("is_leaf").cast("boolean"),
        F.col("value").cast("double"), F.col("weight").cast("double")))
    n_trees = int(nodes.agg(F.max("tree_id")).first()[0]) + 1
    # every row starts at the root (node 0) of every tree: generated, not joined
    cur = df.select(key, features, F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree_id")) \
        .withColumn("node_id", F.lit(0))
    # a leaf routes to itself, so max_depth levels reach every leaf
    for _ in range(max_depth):
        j = cur.join(nb, ["tree_id", "node_id"])
        x = F.element_at(F.col(features), F.col("feature") + 1)
        nxt = F.when(F.col("is_leaf"), F.col("node_id")) \
            .when(x <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        cur = j.select(key, features, "tree_id", nxt.alias("node_id"))
    leaf = cur.join(nb, ["tree_id", "node_id"])
    return leaf.select(key, "tree_id", F.col("value").alias("leaf_value"), "weight")


def ensemble_mean(routed: DataFrame, key: str = "row_id") -> DataFrame:
    """Weighted sum of leaf values per row (weights 1/T for a forest)."""
    return routed.groupBy(key).agg(F.sum(F.col("leaf_value") * F.col("weight")).alias("prediction"))


def _route_in_row(df: DataFrame, trees: list, features: str, key: str, max_depth: int) -> DataFrame:
    lists = [F.array(*[F.lit(t[i].astype(kind)) for t in trees])
             for i, kind in enumerate((np.int32, np.float64, np.int32, np.int32, np.float64))]
    rows = df.select(key, features, F.explode(F.sequence(F.lit(0), F.lit(len(trees) - 1))).alias("tree_id"))
    feature, threshold, left, right, value = (F.get(a, F.col("tree_id")) for a in lists)

    def down(node, _):
        f = F.get(feature, node)
        x = F.get(F.col(features), f)
        return F.when(f < 0, node).when(x <= F.get(threshold, node), F.get(left, node)).otherwise(F.get(right, node))

    # a leaf stays where it is, so max_depth steps reach every leaf
    leaf = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, max_depth))), F.lit(0), down)
    weight = F.get(F.lit(np.array([t[5] for t in trees], float)), F.col("tree_id"))
    return rows.select(key, "tree_id", F.get(value, leaf).alias("leaf_value"), weight.alias("weight"))


def prepare_trees(nodes: DataFrame):
    """Node table → per-tree NumPy arrays, broadcast once (bounded, size checked)."""
    return nodes.sparkSession.sparkContext.broadcast(_tree_arrays(nodes))


def _tree_arrays(nodes: DataFrame) -> list:
    """(feature, threshold, left, right, value, weight) of every tree, by node number."""
    tab = nodes.orderBy("tree_id", "node_id").toPandas()
    if len(tab) > MAX_BROADCAST_NODES:
        raise ValueError("node table too large to broadcast")
    trees = []
    for _, g in tab.groupby("tree_id"):
        g = g.set_index("node_id").sort_index()
        size = int(g.index.max()) + 1
        arr = {c: np.zeros(size, dtype=float if c in ("threshold", "value") else int) for c in
               ("feature", "threshold", "left", "right", "value")}
        for c in arr:
            arr[c][g.index.to_numpy()] = g[c].to_numpy()
        trees.append((arr["feature"], arr["threshold"], arr["left"], arr["right"], arr["value"],
                      float(g["weight"].iloc[0])))
    return trees


def predict_prepared(df: DataFrame, bc, features: str = "features", key: str = "row_id") -> DataFrame:
    """Score rows with broadcast tree arrays: vectorised walk per Arrow batch."""
    key_type = df.schema[key].dataType.simpleString()

    def score(batches):
        tr = bc.value
        for pdf in batches:
            x = np.stack(pdf[features].to_numpy()).astype(float)
            pred = np.zeros(len(x))
            for feat, thr, left, right, val, w in tr:
                node = np.zeros(len(x), dtype=int)
                while True:   # a node's children come after it, so every walk ends
                    internal = feat[node] >= 0
                    if not internal.any():
                        break
                    i = np.flatnonzero(internal)
                    go = x[i, feat[node[i]]] <= thr[node[i]]
                    node[i] = np.where(go, left[node[i]], right[node[i]])
                pred += w * val[node]
            yield pd.DataFrame({key: pdf[key].to_numpy(), "prediction": pred})

    return df.select(key, features).mapInPandas(score, f"{key} {key_type}, prediction double")


def ensemble_predict(df: DataFrame, nodes: DataFrame, features: str = "features",
                     key: str = "row_id") -> DataFrame:
    """Vectorised scoring with the node arrays broadcast once per executor."""
    return predict_prepared(df, prepare_trees(nodes), features, key)
