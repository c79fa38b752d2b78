"""Outlier masks.

Every detector returns a DataFrame ``(row_id, …, is_inlier)``; the mask is a
column on the same row as the target, so filtering keeps X and y aligned
(P3) without positional bookkeeping.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .neighbors import knn
from .ranking import exact_quantiles

# Reference defaults.
N_CLUSTERS, MIN_CLUSTER_RATIO, N_INIT, SEED = 3, 0.1, 10, 42
CONTAMINATION, N_TREES, TREE_SAMPLE = 0.1, 100, 256
LOF_NEIGHBORS = 20


def to_vector(df: DataFrame, array_col: str = "features", out: str = "features_vec") -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>")))


# ------------------------------------------------------- cluster-size mask

def cluster_size_mask(labelled: DataFrame, cluster: str = "cluster",
                      ratio: float = MIN_CLUSTER_RATIO) -> DataFrame:
    """A7 + J4: keep rows whose cluster has ≥ ⌊n·ratio⌋ members (equality kept).

    The valid-cluster table has at most k rows and is broadcast into a left
    semi/anti membership test, so the data side is never shuffled for it.
    """
    counts = labelled.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    n = labelled.count()
    min_size = int(n * ratio)
    valid = counts.where(F.col("size") >= min_size).select(cluster)
    flagged = labelled.join(F.broadcast(valid.withColumn("__ok", F.lit(True))), cluster, "left")
    return flagged.withColumn("is_inlier", F.coalesce(F.col("__ok"), F.lit(False))).drop("__ok")


def cluster_sizes(labelled: DataFrame, cluster: str = "cluster", ratio: float = MIN_CLUSTER_RATIO) -> DataFrame:
    """Per cluster size, threshold and validity."""
    n = labelled.count()
    min_size = int(n * ratio)
    return labelled.groupBy(cluster).agg(F.count(F.lit(1)).cast("bigint").alias("size")) \
        .withColumn("min_size", F.lit(min_size).cast("bigint")) \
        .withColumn("valid", F.col("size") >= F.col("min_size"))


def outlier_rows(mask: DataFrame, key: str = "row_id") -> DataFrame:
    """Keys of rows outside the valid clusters (no collect)."""
    return mask.where(~F.col("is_inlier")).select(key)


def keep_rows(df: DataFrame, mask: DataFrame, key: str = "row_id", remove: bool = True) -> DataFrame:
    """Apply a row mask; with ``remove=False`` rows stay and carry the flag."""
    m = mask.select(key, "is_inlier")
    j = df.join(m, key, "left")
    return j.where(F.col("is_inlier")) if remove else j


# ------------------------------------------------------------- k-means

class Clusters:
    """Centres of a finished k-means and the cost of its last iteration."""

    def __init__(self, centres: np.ndarray, cost: float, features: str):
        self.centres, self.cost, self.features = centres, cost, features

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centres)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``cluster``, the nearest centre."""
        centres = self.centres

        @F.pandas_udf("int")
        def nearest(col: pd.Series) -> pd.Series:
            if not len(col):
                return pd.Series([], dtype="int32")
            x = np.stack(col.to_numpy()).astype(float)
            return pd.Series(np.stack([((x - c) ** 2).sum(1) for c in centres], 1).argmin(1).astype("int32"))

        return df.withColumn("cluster", nearest(F.col(self.features).cast("array<double>")))


def _start(vec: DataFrame, k: int, seed: int, features: str) -> np.ndarray:
    """MLlib's seeded starting centres (k-means||)."""
    from pyspark.ml.clustering import KMeans
    model = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster", maxIter=0).fit(vec)
    return np.array(model.clusterCenters())


def _sums(batches, models, width: int):
    """Per model its centres' sums, counts and cost over the rows outside the fold it leaves out."""
    ends = np.cumsum([len(c) for _, _, c in models])
    centres = np.concatenate([c for _, _, c in models])
    shift = centres.mean(0)   # products of small numbers
    moved = centres - shift
    norms, total = (moved * moved).sum(1), np.zeros((len(centres), width + 2))
    for batch in batches:
        values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        folds = batch.column(1).to_numpy(zero_copy_only=False)
        for lo in range(0, len(values), 4096):
            x, f = values[lo:lo + 4096], folds[lo:lo + 4096]
            near = x - shift
            d = norms[None, :] - 2.0 * (near @ moved.T)
            square, at = (near * near).sum(1), np.arange(len(x))
            hot = np.zeros(d.shape)
            for (_, skip, c), end in zip(models, ends):
                own = d[:, end - len(c):end]
                j = own.argmin(1)
                use = f != skip
                hot[at, end - len(c) + j] = use
                total[end - len(c), width + 1] += np.maximum(0.0, own[at, j] + square)[use].sum()
            total[:, :width] += hot.T @ x
            total[:, width] += hot.sum(0)
    for (m, _, c), end in zip(models, ends):
        yield m, total[end - len(c):end]


def lloyd(df: DataFrame, features: str, starts: Sequence[tuple[int, np.ndarray]], fold: str | None = None,
          max_iter: int = 300, tol: float = 1e-4) -> list[Clusters]:
    """Every start ``(fold it leaves out, centres)`` moved until no centre moves further than ``tol``.

    One job an iteration moves all unfinished starts; tasks send sums, counts and costs of centres, never rows.
    """
    import pyarrow as pa
    if not starts:
        return []
    rows = df.select(F.col(features).cast("array<double>").alias("x"),
                     (F.col(fold) if fold else F.lit(-1)).cast("long").alias("f"))
    at, width = [np.array(c, float) for _, c in starts], len(starts[0][1][0])
    cost, todo = [0.0] * len(starts), list(range(len(starts)))
    for _ in range(max_iter):
        if not todo:
            break
        bc = df.sparkSession.sparkContext.broadcast([(m, starts[m][0], at[m]) for m in todo])

        def partial(batches, bc=bc):
            for m, part in _sums(batches, bc.value, width):
                yield pa.RecordBatch.from_pydict({"m": pa.array([m], pa.int64()), "s": pa.array([part.tobytes()], pa.binary())})

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"m": [pdf["m"].iloc[0]], "s": [sum(np.frombuffer(b) for b in pdf["s"]).tobytes()]})

        moved = rows.mapInArrow(partial, "m long, s binary").groupBy("m").applyInPandas(whole, "m long, s binary").collect()
        todo = []
        for r in moved:   # one row per start, of its centres' size
            m, s = r["m"], np.frombuffer(r["s"]).reshape(-1, width + 2)
            some = s[:, width] > 0
            new = at[m].copy()
            new[some] = s[some, :width] / s[some, width][:, None]
            far = ((new - at[m]) ** 2).sum(1).max() > tol * tol
            at[m], cost[m] = new, float(s[:, width + 1].sum())
            if far:
                todo.append(m)
        bc.unpersist()
    return [Clusters(c, v, features) for c, v in zip(at, cost)]


def best_kmeans(vec: DataFrame, k: int, n_init: int = N_INIT, seed: int = SEED,
                features: str = "features_vec", threads: int = 4, array: str = "features") -> Clusters:
    """The lowest-cost of ``n_init`` seeded fits from MLlib's starts, moved together."""
    with ThreadPoolExecutor(max_workers=min(threads, n_init)) as ex:
        starts = list(ex.map(lambda s: (-2, _start(vec, k, s, features)), [seed + i for i in range(n_init)]))
    return min(lloyd(vec, array, starts), key=lambda m: m.cost)


def kmeans_mask(df: DataFrame, features: str = "features", k: int = N_CLUSTERS,
                ratio: float = MIN_CLUSTER_RATIO, n_init: int = N_INIT, seed: int = SEED) -> DataFrame:
    """Cluster with k-means, then mask clusters smaller than ⌊n·ratio⌋."""
    vec = to_vector(df, features).cache()
    model = best_kmeans(vec, k, n_init, seed, array=features)
    labelled = model.transform(vec).drop("features_vec")
    vec.unpersist()
    return cluster_size_mask(labelled, "cluster", ratio)


def kmeans_state(df: DataFrame, k: int = N_CLUSTERS, ratio: float = MIN_CLUSTER_RATIO, n_init: int = N_INIT,
                 seed: int = SEED, features: str = "features") -> dict:
    """Fitted centres and which of their clusters are large enough (k rows at most)."""
    vec = to_vector(df, features).cache()
    model = best_kmeans(vec, k, n_init, seed, array=features)
    sizes = {r["cluster"]: r["valid"] for r in cluster_sizes(model.transform(vec), "cluster", ratio).collect()}
    vec.unpersist()
    centres = [[float(v) for v in c] for c in model.clusterCenters()]
    return {"centres": centres, "valid": [bool(sizes.get(i, False)) for i in range(len(centres))]}


def kmeans_judge(spark, state: dict):
    """Column function: is the nearest centre's cluster valid?  For fitted and new rows alike."""
    bc = spark.sparkContext.broadcast((np.array(state["centres"]), np.array(state["valid"])))

    @F.pandas_udf("boolean")
    def judge(col: pd.Series) -> pd.Series:
        centres, valid = bc.value
        if not len(col):
            return pd.Series([], dtype=bool)
        x = np.stack(col.to_numpy()).astype(float)
        return pd.Series(valid[np.stack([((x - c) ** 2).sum(1) for c in centres], 1).argmin(1)])

    return judge


def best_kmeans_mask(df: DataFrame, features: str = "features", ks: Sequence[int] = range(2, 9), folds: int = 3,
                     ratio: float = MIN_CLUSTER_RATIO, n_init: int = N_INIT, seed: int = SEED,
                     key: str = "row_id") -> DataFrame:
    """Choose k by cross-validated silhouette, refit on all rows, mask small clusters."""
    best = choose_k(df, features, ks, folds, n_init, seed, key).where("chosen").first()
    return kmeans_mask(df, features, int(best["k"]) if best else N_CLUSTERS, ratio, n_init, seed)


def silhouette(labelled: DataFrame, features: str = "features_vec", cluster: str = "cluster") -> float:
    """Mean silhouette from MLlib (squared Euclidean, O(n·k) — no pairs)."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    ev = ClusteringEvaluator(featuresCol=features, predictionCol=cluster,
                             metricName="silhouette", distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(labelled))


def choose_k(df: DataFrame, features: str = "features", ks: Sequence[int] = range(2, 9),
             folds: int = 3, n_init: int = N_INIT, seed: int = SEED, key: str = "row_id") -> DataFrame:
    """Mean train-fold silhouette per k (3 shuffled folds); best k, ties → smaller k.

    Returns (k, mean_silhouette, n_folds, chosen).
    """
    from ..functions.hashing import hash_bucket
    vec = to_vector(df, features).withColumn("__fold", hash_bucket(key, f"{seed}:kfold", folds)).cache()
    sizes = {r["__fold"]: r["count"] for r in vec.groupBy("__fold").count().collect()}
    jobs = [(k, f) for k in ks for f in range(folds) if sum(sizes.values()) - sizes.get(f, 0) >= k]
    train = {f: vec.where(F.col("__fold") != f) for f in range(folds)}

    def score(job):
        k, f, model = job
        lab = model.transform(train[f])
        if lab.select("cluster").distinct().count() <= 1:   # A8
            return k, f, None
        return k, f, silhouette(lab)

    # starts and scores are small jobs and run side by side; all fits move together
    with ThreadPoolExecutor(max_workers=8) as ex:
        tries = [(k, f, seed + i) for k, f in jobs for i in range(n_init)]
        starts = list(ex.map(lambda t: (t[1], _start(train[t[1]], t[0], t[2], "features_vec")), tries))
        models = lloyd(vec, features, starts, "__fold")
        best_of = [min(models[i * n_init:(i + 1) * n_init], key=lambda m: m.cost) for i in range(len(jobs))]
        res = list(ex.map(score, [(k, f, m) for (k, f), m in zip(jobs, best_of)]))
    vec.unpersist()
    rows = []
    for k in ks:
        s = [v for kk, _, v in res if kk == k and v is not None]
        rows.append((int(k), float(np.mean(s)) if s else None, len(s)))
    best = max((r for r in rows if r[1] is not None), key=lambda r: (r[1], -r[0]), default=None)
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("mean_silhouette", T.DoubleType()),
                           T.StructField("n_folds", T.IntegerType())])
    out = df.sparkSession.createDataFrame(rows, schema)
    return out.withColumn("chosen", F.col("k") == F.lit(best[0] if best else ks[0]))


# ----------------------------------------------------- isolation forest

def _c_factor(n):
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(pdf: pd.DataFrame, max_depth: int, seed: int) -> pd.DataFrame:
    tree_id = int(pdf["tree_id"].iloc[0])
    rng = np.random.default_rng(seed + tree_id)
    x = np.stack(pdf["features"].to_numpy()).astype(float)
    rows = []  # node_id, feature, threshold, left, right, size, depth

    def build(idx, depth):
        node = len(rows)
        rows.append(None)
        xs = x[idx]
        if depth >= max_depth or len(idx) <= 1:
            rows[node] = (node, -1, 0.0, -1, -1, len(idx), depth)
            return node
        lo, hi = xs.min(axis=0), xs.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            rows[node] = (node, -1, 0.0, -1, -1, len(idx), depth)
            return node
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        go_left = xs[:, f] < t
        left = build(idx[go_left], depth + 1)
        right = build(idx[~go_left], depth + 1)
        rows[node] = (node, f, t, left, right, len(idx), depth)
        return node

    build(np.arange(len(x)), 0)
    out = pd.DataFrame(rows, columns=["node_id", "feature", "threshold", "left", "right", "size", "depth"])
    out.insert(0, "tree_id", tree_id)
    return out


_NODE_SCHEMA = ("tree_id int, node_id int, feature int, threshold double, left int, right int, "
                "size long, depth int")


def isolation_forest_nodes(df: DataFrame, features: str = "features", trees: int = N_TREES,
                           sample: int = TREE_SAMPLE, seed: int = SEED, key: str = "row_id") -> DataFrame:
    """Grow ``trees`` isolation trees on per-tree samples of ``sample`` rows.

    Each row draws one hash per tree and joins the tree's sample when the draw
    is below 2·sample/n; the per-tree sample is then cut to the ``sample``
    smallest draws, so a tree group holds at most about 2·sample rows.
    """
    n = df.count()
    m = min(sample, n)
    p = min(1.0, 2.0 * m / n)
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)),
                        lambda t: F.struct(t.alias("tree_id"),
                                           (F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(1 << 30))
                                            / F.lit(float(1 << 30))).alias("u")))
    picked = df.select(key, features, F.filter(draws, lambda d: d["u"] < p).alias("__d")) \
        .select(key, features, F.explode("__d").alias("d")) \
        .select(key, features, F.col("d.tree_id").alias("tree_id"), F.col("d.u").alias("u"))
    from pyspark.sql import Window
    w = Window.partitionBy("tree_id").orderBy("u", key)   # group bounded by ~2·sample rows
    picked = picked.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= m)
    max_depth = int(math.ceil(math.log2(max(m, 2))))
    return picked.select("tree_id", F.col(features).alias("features")).groupBy("tree_id").applyInPandas(
        lambda pdf: _grow(pdf, max_depth, seed), _NODE_SCHEMA)


def isolation_scores(df: DataFrame, nodes: DataFrame, features: str = "features",
                     sample: int = TREE_SAMPLE, key: str = "row_id") -> DataFrame:
    """Score every row: s = −2^(−E[h(x)]/c(ψ)) (higher = more normal, as score_samples)."""
    tab = nodes.orderBy("tree_id", "node_id").toPandas()   # at most trees · (2·sample − 1) rows
    trees = {}
    for t, g in tab.groupby("tree_id"):
        trees[int(t)] = tuple(g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "size", "depth"))
    psi = int(tab[tab["node_id"] == 0]["size"].max())
    bc = df.sparkSession.sparkContext.broadcast((trees, float(_c_factor([psi])[0])))

    def score(batches):
        tr, c_psi = bc.value
        for pdf in batches:
            x = np.stack(pdf[features].to_numpy()).astype(float)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "score": _isolation_values(x, list(tr.values()), c_psi)})

    return df.select(key, features).mapInPandas(score, f"{key} long, score double")


def isolation_forest_mask(df: DataFrame, features: str = "features", trees: int = N_TREES,
                          contamination: float = CONTAMINATION, seed: int = SEED,
                          key: str = "row_id") -> DataFrame:
    """Outlier when the score is strictly below its ``contamination`` quantile."""
    nodes = isolation_forest_nodes(df, features, trees, seed=seed, key=key).cache()
    scores = isolation_scores(df, nodes, features, key=key).checkpoint(eager=True)
    nodes.unpersist()
    cut = exact_quantiles(scores, "score", [contamination], tiebreak=[key], names=["cut"]).first()["cut"]
    return scores.withColumn("is_inlier", F.col("score") >= F.lit(cut))


def isolation_state(df: DataFrame, trees: int = N_TREES, contamination: float = CONTAMINATION, seed: int = SEED,
                    features: str = "features", key: str = "row_id") -> dict:
    """Fitted trees and the score cut; trees * (2 * sample - 1) nodes at most."""
    nodes = materialize(isolation_forest_nodes(df, features, trees, seed=seed, key=key))
    scores = isolation_scores(df, nodes, features, key=key)
    cut = exact_quantiles(scores, "score", [contamination], names=["cut"]).first()["cut"]
    rows = nodes.orderBy("tree_id", "node_id").collect()
    names = ("tree_id", "feature", "threshold", "left", "right", "size", "depth")
    return {"cut": float(cut), "psi": max(int(r["size"]) for r in rows if r["node_id"] == 0),
            **{c: [r[c] for r in rows] for c in names}}


def isolation_judge(spark, state: dict):
    """Column function: is the isolation score at or above the fitted cut?"""
    tree = np.array(state["tree_id"])
    cols = [np.array([np.nan if v is None else v for v in state[c]]) for c in
            ("feature", "threshold", "left", "right", "size", "depth")]
    forest = []
    for t in np.unique(tree):
        f, thr, left, right, size, depth = (c[tree == t] for c in cols)
        forest.append((f.astype(int), thr, np.nan_to_num(left).astype(int), np.nan_to_num(right).astype(int),
                       size.astype(int), depth.astype(int)))
    bc = spark.sparkContext.broadcast((forest, float(_c_factor([state["psi"]])[0]), state["cut"]))

    @F.pandas_udf("boolean")
    def judge(col: pd.Series) -> pd.Series:
        forest, c_psi, cut = bc.value
        if not len(col):
            return pd.Series([], dtype=bool)
        x = np.stack(col.to_numpy()).astype(float)
        return pd.Series(_isolation_values(x, forest, c_psi) >= cut)

    return judge


def _isolation_values(x: np.ndarray, forest, c_psi: float) -> np.ndarray:
    """-2 ** (-mean path length / c(psi)) of every row."""
    depth_sum = np.zeros(len(x))
    for feat, thr, left, right, size, dep in forest:
        node = np.zeros(len(x), dtype=int)
        while True:
            idx = np.flatnonzero(feat[node] >= 0)
            if not len(idx):
                break
            at = node[idx]
            node[idx] = np.where(x[idx, feat[at]] < thr[at], left[at], right[at])
        depth_sum += dep[node] + _c_factor(size[node])
    return -np.power(2.0, -depth_sum / len(forest) / c_psi)


# ------------------------------------------------- local outlier factor

def lof(df: DataFrame, k: int = LOF_NEIGHBORS, contamination: float = CONTAMINATION,
        features: str = "features", key: str = "row_id") -> DataFrame:
    """Local outlier factor with k = min(k, n − 1); inlier unless −LOF is
    strictly below its ``contamination`` quantile.  Returns (row_id, lof, is_inlier).
    """
    n = df.count()
    k = min(k, n - 1)
    nb = materialize(knn(df, k, features, key))
    kdist = nb.where(F.col("rank") == k).select(F.col(key).alias("neighbor"), F.col("dist").alias("kdist_nb"))
    reach = nb.join(kdist, "neighbor").withColumn("reach", F.greatest("dist", "kdist_nb"))
    lrd = reach.groupBy(key).agg((1.0 / (F.avg("reach") + F.lit(1e-10))).alias("lrd"))
    nb_lrd = nb.select(key, "neighbor").join(lrd.select(F.col(key).alias("neighbor"), F.col("lrd").alias("lrd_nb")),
                                             "neighbor")
    ratio = nb_lrd.groupBy(key).agg(F.avg("lrd_nb").alias("mean_lrd_nb"))
    out = ratio.join(lrd, key).select(key, (F.col("mean_lrd_nb") / F.col("lrd")).alias("lof"))
    out = materialize(out)
    neg = out.withColumn("nof", -F.col("lof"))
    cut = exact_quantiles(neg, "nof", [contamination], tiebreak=[key], names=["cut"]).first()["cut"]
    return out.withColumn("is_inlier", -F.col("lof") >= F.lit(cut))
