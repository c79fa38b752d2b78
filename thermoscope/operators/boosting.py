"""Leaf-wise gradient boosting on binned columns, with row and column sampling.

* **Bins.**  One aggregate of mergeable sketches gives every feature at most
  ``max_bins - 1`` cut points; each row becomes one byte per feature.  This narrow copy
  (bins, target, prediction) is all that the rounds read.
* **Histograms.**  A pass walks every sampled row to its leaf and adds gradients
  and counts into arrays (leaf, feature, bin) inside the task; the non-empty cells of all
  tasks meet in one ``groupBy`` sum.  Only the smaller child of a split is
  counted, its sibling is the parent's histogram minus it.
* **Leaf-wise growth.**  The open leaf of greatest gain is split next, until ``num_leaves``.
  One pass counts the children of all open leaves that could still be chosen, so a
  tree takes about as many passes as it has levels; which leaves are split does
  not depend on that.  Cumulative sums, gains and the choice per leaf are
  window and aggregate functions; the driver sees one row per open leaf.
* **Sampling.**  Rows of a round are those whose portable hash of (key, round) is below
  ``subsample``; columns are the first ``ceil(colsample * d)`` by the hash of (feature, round).
* **Predictions** of finished trees are added when rows are read; the copy is rewritten
  every ``KEEP_TREES`` rounds, the former one dropped.

The loss is squared error: a leaf's value is ``learning_rate * G / (n + l2)`` with G the
sum of residuals.  Equal gains (to ten digits of the largest possible) go to the smaller
feature, then the smaller bin, then the older leaf.  A null or NaN feature counts as smaller than any
number and goes left; rows with a null target are not used.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from ..session import TableStore

MAX_BINS = 255
ACCURACY = 10_000
KEEP_TREES = 10
GAIN_DIGITS = 10


@dataclass
class Node:
    """A node of the tree being grown: its rows, residual sum and, once known, its best split."""
    rows: int
    total: float
    depth: int
    gain: float = 0.0
    feature: int = -1
    bin: int = -1
    left_rows: int = 0
    left_total: float = 0.0
    children: tuple[int, int] | None = None   # counted, but a split only if chosen
    split: bool = False
    rank: int = -1                            # place among the tree's splits


@dataclass
class Boosted:
    """A fitted model: cut points of every feature and one node list per tree."""
    edges: list[np.ndarray]
    start: float
    learning_rate: float
    l2: float
    trees: list[list[Node]] = field(default_factory=list)

    def value(self, node: Node) -> float:
        return self.learning_rate * node.total / (node.rows + self.l2) if node.rows else 0.0

    def node_rows(self):
        """(tree_id, node_id, feature, threshold, left, right, value, is_leaf, weight, rows, gain); tree 0 is the mean."""
        out = [(0, 0, -1, 0.0, -1, -1, self.start, True, 1.0, self.trees[0][0].rows if self.trees else 0, 0.0)]
        for t, nodes in enumerate(self.trees, 1):
            renamed, order = {0: 0}, [0]
            for i in sorted((i for i, n in enumerate(nodes) if n.split), key=lambda i: nodes[i].rank):
                for c in nodes[i].children:
                    renamed[c] = len(order)
                    order.append(c)
            for i in order:
                n = nodes[i]
                if n.split:
                    left, right = (renamed[c] for c in n.children)
                    out.append((t, renamed[i], n.feature, float(self.edges[n.feature][n.bin]), left, right, 0.0, False,
                                1.0, n.rows, n.gain))
                else:
                    out.append((t, renamed[i], -1, 0.0, -1, -1, self.value(n), True, 1.0, n.rows, 0.0))
        return out

    def nodes(self, spark) -> DataFrame:
        """The node table that ``trees.ensemble_predict`` and ``trees.route`` read."""
        return spark.createDataFrame(self.node_rows(), "tree_id int, node_id int, feature int, threshold double, left int, "
                                     "right int, value double, is_leaf boolean, weight double, n_rows long, gain double")

    def transform(self, df: DataFrame, features: str, out: str = "prediction") -> DataFrame:
        """Every row with its prediction; the trees are broadcast (rounds x num_leaves nodes)."""
        bc = df.sparkSession.sparkContext.broadcast((self.edges, self.start, [_packed(self, t) for t in self.trees]))

        @F.pandas_udf("double")
        def score(col):
            import pandas as pd
            edges, start, trees = bc.value
            bins = _bins_of(_matrix(col.to_numpy(), len(edges)), edges)
            pred = np.full(len(bins), start)
            for tree in trees:
                pred += tree[4][_walk(bins, tree)]
            return pd.Series(pred)

        return df.withColumn(out, score(F.col(features)))


def _matrix(rows, width: int) -> np.ndarray:
    x = np.array([np.asarray(r, float) for r in rows], float).reshape(-1, width)
    return np.where(np.isnan(x), -np.inf, x)


def _bins_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin b holds the values above edge b - 1 up to edge b."""
    out = np.empty(x.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.searchsorted(e, x[:, f], side="left")
    return out


def _packed(model: Boosted, nodes: list[Node], candidates: bool = False):
    """Arrays (feature, bin, left, right, value) of a tree; ``candidates`` also follows counted, unchosen splits."""
    inner = [n.children is not None and (candidates or n.split) for n in nodes]
    return (np.array([n.feature if i else -1 for n, i in zip(nodes, inner)]), np.array([n.bin for n in nodes]),
            np.array([n.children[0] if i else 0 for n, i in zip(nodes, inner)]),
            np.array([n.children[1] if i else 0 for n, i in zip(nodes, inner)]),
            np.array([model.value(n) for n in nodes]))


def _walk(bins: np.ndarray, tree) -> np.ndarray:
    feature, cut, left, right, _ = tree
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(rows):
        rows = rows[feature[at[rows]] >= 0]
        here = at[rows]
        at[rows] = np.where(bins[rows, feature[here]] <= cut[here], left[here], right[here])
    return at


def bin_edges(df: DataFrame, features: str, max_bins: int = MAX_BINS, accuracy: int = ACCURACY) -> list[np.ndarray]:
    """Ascending distinct cut points of every feature (at most ``max_bins - 1``), from one sketch aggregate."""
    long = df.select(F.posexplode(features).alias("f", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    probs = [k / max_bins for k in range(1, max_bins)]
    rows = long.groupBy("f").agg(F.percentile_approx(F.col("v").cast("double"), probs, accuracy).alias("e")).collect()
    width = df.select(F.max(F.size(features))).first()[0] or 0
    edges = [np.empty(0)] * width
    for r in rows:   # one row per feature
        edges[r["f"]] = np.unique(np.array(r["e"], float))
    return edges


def sampled_columns(width: int, share: float, seed: int, round_: int) -> list[int]:
    """The first ``ceil(share * width)`` features by md5 of ``feature:seed:cols:round``."""
    k = max(1, math.ceil(share * width - 1e-9))
    key = lambda f: int(hashlib.md5(f"{f}:{seed}:cols:{round_}".encode()).hexdigest()[:8], 16)
    return sorted(sorted(range(width), key=lambda f: (key(f), f))[:k])


def _binned(df: DataFrame, features: str, y: str, key: str, edges, start: float) -> DataFrame:
    bc = df.sparkSession.sparkContext.broadcast(edges)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            bins = _bins_of(_matrix(b.column(1).to_pylist(), len(bc.value)), bc.value)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r.tobytes() for r in bins], pa.binary()), b.column(2),
                 pa.array(np.full(len(bins), start))], ["key", "bins", "y", "pred"])

    rows = df.where(F.col(y).isNotNull()).select(key, F.col(features).cast("array<double>"), F.col(y).cast("double"))
    return rows.mapInArrow(run, f"key {kind}, bins binary, y double, pred double")


def _arrays(batch, width: int):
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)
    return bins, batch.column("y").to_numpy(), batch.column("pred").to_numpy()


def _advanced(binned: DataFrame, width: int, trees) -> DataFrame:
    """The binned rows with the outputs of finished trees added to their predictions."""
    bc = binned.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for b in batches:
            bins, y, pred = _arrays(b, width)
            for tree in bc.value:
                pred = pred + tree[4][_walk(bins, tree)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("bins"), pa.array(y), pa.array(pred)],
                                             ["key", "bins", "y", "pred"])

    return binned.mapInArrow(run, binned.schema)


def _histograms(rows: DataFrame, width: int, n_bins: int, done, tree, wanted: list[int], columns: list[int]) -> DataFrame:
    """``node, feature, bin, g, n`` of the wanted nodes: one partial per task and non-empty cell, summed in one shuffle."""
    bc = rows.sparkSession.sparkContext.broadcast((done, tree, wanted, columns))

    def run(batches):
        trees, grown, nodes, cols = bc.value
        slot = np.full(max(nodes) + 1, -1)
        slot[nodes] = np.arange(len(nodes))
        shape = (len(nodes), len(cols), n_bins)
        g, n = np.zeros(shape), np.zeros(shape, np.int64)
        for b in batches:
            bins, y, pred = _arrays(b, width)
            for t in trees:
                pred = pred + t[4][_walk(bins, t)]
            # candidate splits of the wanted nodes are not followed: the walk stops at them
            at = _walk(bins, grown)
            at = np.where(at <= max(nodes), slot[np.minimum(at, max(nodes))], -1)
            here = at >= 0
            at, bins, grad = at[here], bins[here], (y - pred)[here]
            for k, f in enumerate(cols):
                cell = at * n_bins + bins[:, f]
                g[:, k] += np.bincount(cell, grad, len(nodes) * n_bins).reshape(len(nodes), n_bins)
                n[:, k] += np.bincount(cell, minlength=len(nodes) * n_bins).reshape(len(nodes), n_bins)
        i, k, b = np.nonzero(n)
        if len(i):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(nodes)[i], pa.int32()), pa.array(np.array(cols)[k], pa.int32()), pa.array(b, pa.int32()),
                 pa.array(g[i, k, b]), pa.array(n[i, k, b])], ["node", "feature", "bin", "g", "n"])

    parts = rows.select("bins", "y", "pred").mapInArrow(run, "node int, feature int, bin int, g double, n long")
    return parts.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))


def _siblings(parent: DataFrame, child: DataFrame, pairs: list[tuple[int, int, int]]) -> DataFrame:
    """Histograms of the larger children: the parent's minus the smaller child's.  ``pairs``: (parent, smaller, larger)."""
    spark = parent.sparkSession
    who = F.broadcast(spark.createDataFrame(pairs, "p int, small int, large int"))   # at most num_leaves rows
    a = parent.join(who, F.col("node") == F.col("p")).select("small", "large", "feature", "bin", "g", "n")
    b = child.select(F.col("node").alias("small"), "feature", "bin", F.col("g").alias("cg"), F.col("n").alias("cn"))
    left = F.col("n") - F.coalesce("cn", F.lit(0))
    return a.join(b, ["small", "feature", "bin"], "left").where(left > 0).select(
        F.col("large").alias("node"), "feature", "bin", (F.col("g") - F.coalesce("cg", F.lit(0.0))).alias("g"),
        left.alias("n"))


def best_splits(hist: DataFrame, l2: float, min_rows: int, scale: float) -> DataFrame:
    """The best split of every node: ``node, rows, total, gain, feature, bin, left_rows, left_total``.

    Cuts stand after non-empty bins.  A window holds one feature's bins of one node.
    """
    upto = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("node", "feature")
    c = hist.select("node", "feature", "bin", F.sum("g").over(upto).alias("gl"), F.sum("n").over(upto).alias("nl"),
                    F.sum("g").over(whole).alias("g"), F.sum("n").over(whole).alias("n"))
    gr, nr = F.col("g") - F.col("gl"), F.col("n") - F.col("nl")
    part = lambda s, k: s * s / (k + F.lit(float(l2)))
    gain = part(F.col("gl"), F.col("nl")) + part(gr, nr) - part(F.col("g"), F.col("n"))
    fit = (F.col("nl") >= min_rows) & (nr >= min_rows)
    share = F.round(F.when(fit, gain) / F.lit(float(scale) or 1.0), GAIN_DIGITS)
    c = c.withColumn("share", F.coalesce(share, F.lit(0.0)))
    order = F.struct("share", -F.col("feature"), -F.col("bin"))
    return c.groupBy("node").agg(F.max_by(F.struct("n", "g", "share", "feature", "bin", "nl", "gl"), order).alias("b")).select(
        "node", F.col("b.n").alias("rows"), F.col("b.g").alias("total"), F.col("b.share").alias("gain"), "b.feature", "b.bin",
        F.col("b.nl").alias("left_rows"), F.col("b.gl").alias("left_total"))


def _grow(store: TableStore, rows: DataFrame, model: Boosted, done, columns, width, num_leaves, min_rows, max_depth, n_bins):
    """One tree: passes over the rows until ``num_leaves`` are chosen or no gain is left."""
    nodes: list[Node] = []
    scale = [1.0]
    hist, step = None, 0

    def count(wanted: list[int], pairs) -> None:
        """Histograms and best splits of new nodes."""
        nonlocal hist, step
        step += 1
        tree = _packed(model, nodes, candidates=True) if nodes else (np.array([-1]),) * 5
        fresh = _histograms(rows, width, n_bins, done, tree, wanted, columns)
        if pairs:
            fresh = store.write(fresh, f"small-{step}")
            fresh = fresh.unionByName(_siblings(hist, fresh, pairs))
        new = [s for p in pairs for s in p[1:]] or wanted
        still = [i for i, n in enumerate(nodes) if n.children is None and i not in new and n.gain > 0]
        if hist is not None and still:
            fresh = fresh.unionByName(hist.where(F.col("node").isin(still)))
        hist = store.write(fresh, f"hist-{step}")
        store.drop(f"hist-{step - 1}")
        store.drop(f"small-{step}")
        if not nodes:   # gains are shares of the most that a split of the root could give
            top = hist.groupBy("feature").agg(F.sum(F.col("g") * F.col("g") / F.col("n")).alias("most"), F.sum("n").alias("n"),
                                              F.sum("g").alias("g")).agg(F.max("most"), F.max("n"), F.min_by("g", "feature")).first()
            scale[0] = float(top[0] or 0.0) or 1.0
            nodes.append(Node(int(top[1] or 0), float(top[2] or 0.0), 0))
        for r in best_splits(hist.where(F.col("node").isin(new)), model.l2, min_rows, scale[0]).collect():
            n = nodes[r["node"]]   # one row per open leaf
            if r["gain"] > 0 and (max_depth <= 0 or n.depth < max_depth):
                n.gain, n.feature, n.bin = r["gain"], r["feature"], r["bin"]
                n.left_rows, n.left_total = int(r["left_rows"]), float(r["left_total"])

    count([0], [])
    chosen, open_ = 1, [0]
    while chosen < num_leaves:
        best = max((i for i in open_ if nodes[i].gain > 0), key=lambda i: (nodes[i].gain, -i), default=None)
        if best is None:
            break
        if nodes[best].children is None:
            # the leaves that could be among the next ones chosen, counted in one pass
            able = sorted((i for i in open_ if nodes[i].gain > 0 and nodes[i].children is None),
                          key=lambda i: (-nodes[i].gain, i))[:num_leaves - chosen]
            pairs = []
            for i in able:
                n = nodes[i]
                left = Node(n.left_rows, n.left_total, n.depth + 1)
                right = Node(n.rows - n.left_rows, n.total - n.left_total, n.depth + 1)
                n.children = (len(nodes), len(nodes) + 1)
                nodes.extend((left, right))
                small, large = n.children if left.rows <= right.rows else n.children[::-1]
                pairs.append((i, small, large))
            count([p[1] for p in pairs], pairs)
        n = nodes[best]
        n.split, n.rank = True, chosen
        open_ = [i for i in open_ if i != best] + list(n.children)
        chosen += 1
    store.drop(f"hist-{step}")
    return nodes


def fit_boosting(df: DataFrame, features: str, y: str, key: str = "row_id", rounds: int = 100, learning_rate: float = 0.1,
                 num_leaves: int = 31, max_depth: int = -1, min_rows: int = 20, l2: float = 0.0, subsample: float = 1.0,
                 colsample: float = 1.0, max_bins: int = MAX_BINS, seed: int = 42) -> Boosted:
    """Fit ``rounds`` trees of at most ``num_leaves`` leaves to an array column.

    ``num_leaves = 2**max_depth`` with a depth gives level-bounded trees.
    """
    if not 2 <= max_bins <= 256:
        raise ValueError("a bin is one byte: 2 to 256 bins")
    store = TableStore(df.sparkSession)
    edges = bin_edges(df, features, max_bins)
    width = len(edges)
    start = df.where(F.col(y).isNotNull()).agg(F.avg(F.col(y).cast("double"))).first()[0]
    model = Boosted(edges, float(start if start is not None else 0.0), learning_rate, l2)
    if start is None or not width:
        return model
    rows, kept = store.write(_binned(df, features, y, key, edges, model.start), "rows-0"), 0
    n_bins = max(len(e) for e in edges) + 1
    for r in range(rounds):
        if r - kept == KEEP_TREES:
            done = [_packed(model, t) for t in model.trees[kept:r]]
            fresh = store.write(_advanced(rows, width, done), f"rows-{r}")
            store.drop(f"rows-{kept}")
            rows, kept = fresh, r
        part = rows if subsample >= 1 else rows.where(
            hash32("key", f"{seed}:rows:{r}") < int(subsample * 4294967296))
        done = [_packed(model, t) for t in model.trees[kept:]]
        columns = sampled_columns(width, colsample, seed, r)
        model.trees.append(_grow(store, part, model, done, columns, width, num_leaves, min_rows, max_depth, n_bins))
    store.close()
    return model
