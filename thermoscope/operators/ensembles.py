"""Models MLlib lacks: extremely randomised trees, AdaBoost.R2, RBF regression.

* Extra trees grow level by level.  Per level one aggregate gives each
  (tree, node, feature) its min/max; a seeded hash draws one threshold per
  (tree, node, feature) in [min, max); a second aggregate gives the left/right
  count, Σy, Σy² of that threshold; the best gain per node wins.  Every tree
  sees all rows (no bootstrap, as the reference).  Rows are stored once and
  walk down the broadcast nodes in each pass; a task sends one row per
  (tree, node, feature) it has seen.
* AdaBoost.R2 (Drucker, 1997) fits depth-3 trees to weighted rows as MLlib grows them (32 bins at even steps of
  weight over at most about 10,000 drawn rows, variance gain), in one pass and one for the errors: with few features
  the sums of all combinations of their bins hold every split of every level (with more, a pass for each level).  A round's
  trees are small, so a pass works out the weights of the last rounds again, and rows are rewritten every few rounds.
  Rows are stored in small blocks of bytes: as columns of numbers their way from file to worker took most of a pass.
  The rounds are combined by the weighted median.
* RBF regression maps rows to random Fourier features and fits an
  ε-insensitive linear model by full-batch subgradient steps, one aggregate
  per step (declared approximation of kernel SVR).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_unit
from ..session import TableStore, materialize
from .trees import MAX_BROADCAST_NODES, ensemble_predict


# ------------------------------------------------------------- extra trees

def extra_trees(df: DataFrame, features: str, y: str, n_trees: int = 100, max_depth: int = 8,
                min_samples_split: int = 2, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Returns a node table usable by :func:`ensemble_predict` / :func:`route`.

    A missing value draws no threshold and goes right; rows without ``y`` are left out.
    """
    spark = df.sparkSession
    data = materialize(df.select(F.col(features).alias("x"), F.col(y).cast("double").alias("y")).where("y IS NOT NULL"))
    d = data.agg(F.max(F.size("x"))).first()[0]
    if d is None:
        raise ValueError("extra trees need rows")
    model = _Grown(n_trees)
    for depth in range(max_depth + 1):
        n_active = len(model.heap) - model.base
        if not n_active:
            break
        if len(model.heap) > MAX_BROADCAST_NODES:
            raise ValueError("extra-trees level too large to broadcast")
        feature, threshold = np.full(n_active, -1), np.zeros(n_active)
        step = max(1, SLICE_CELLS // max(1, d))
        for lo in range(0, n_active, step):   # nodes of one pass, so that a task's sums have a fixed size
            part = slice(lo, min(lo + step, n_active))
            _split_nodes(data, model, part, depth, d, depth < max_depth, min_samples_split, seed, feature, threshold)
        model.grow(feature, threshold)
    return spark.createDataFrame(model.table())


SLICE_CELLS = 1 << 20   # (node, feature) cells of one pass


class _Grown:
    """Nodes of all trees, level by level; the nodes from ``base`` on are those of the present level."""

    def __init__(self, n_trees: int):
        self.n_trees = n_trees
        self.tree, self.heap = np.arange(n_trees), np.zeros(n_trees, np.int64)
        self.feature, self.threshold = np.full(n_trees, -1), np.zeros(n_trees)
        self.left, self.value = np.full(n_trees, -1), np.zeros(n_trees)   # a right child follows its left one
        self.base = 0

    def grow(self, feature: np.ndarray, threshold: np.ndarray) -> None:
        base, size = self.base, len(self.heap)
        cut = np.flatnonzero(feature >= 0)
        self.feature[base:], self.threshold[base:] = feature, threshold
        self.left[base + cut] = size + 2 * np.arange(len(cut))
        heap = self.heap[base + cut]
        self.heap = np.concatenate((self.heap, np.column_stack((2 * heap + 1, 2 * heap + 2)).ravel()))
        self.tree = np.concatenate((self.tree, np.repeat(self.tree[base + cut], 2)))
        more = 2 * len(cut)
        self.feature, self.left = (np.concatenate((v, np.full(more, -1))) for v in (self.feature, self.left))
        self.threshold, self.value = (np.concatenate((v, np.zeros(more))) for v in (self.threshold, self.value))
        self.base = size

    def table(self) -> pd.DataFrame:
        order = np.lexsort((self.heap, self.tree))
        first = np.searchsorted(self.tree[order], self.tree[order])
        dense = np.empty(len(order), np.int64)
        dense[order] = np.arange(len(order)) - first
        leaf = self.feature < 0
        child = np.where(leaf, 0, self.left)
        pdf = pd.DataFrame({
            "tree_id": self.tree, "node_id": dense, "feature": self.feature, "threshold": self.threshold,
            "left": np.where(leaf, -1, dense[child]), "right": np.where(leaf, -1, dense[np.where(leaf, 0, child + 1)]),
            "value": np.where(leaf, self.value, 0.0), "is_leaf": leaf}).iloc[order].reset_index(drop=True)
        pdf["weight"] = 1.0 / self.n_trees
        return pdf


def _split_nodes(data: DataFrame, model: _Grown, part: slice, depth: int, d: int, may_split: bool,
                 min_samples_split: int, seed: int, feature: np.ndarray, threshold: np.ndarray) -> None:
    """Values of the level's nodes in ``part``, and their best splits (into ``feature`` and ``threshold``)."""
    base, k = model.base, part.stop - part.start
    nodes = slice(base + part.start, base + part.stop)
    tree, heap = model.tree[nodes], model.heap[nodes]
    place = pd.Series(np.arange(k), index=pd.MultiIndex.from_arrays([tree, heap]))
    sc = data.sparkSession.sparkContext
    walk = dict(feature=model.feature, threshold=model.threshold, left=model.left, depth=depth, d=d,
                trees=np.unique(tree), first=nodes.start, tree=tree, heap=heap)

    def cells(pdf: pd.DataFrame):
        return place.loc[pd.MultiIndex.from_arrays([pdf["tree_id"], pdf["node"]])].to_numpy(), pdf["f"].to_numpy()

    bc = sc.broadcast(walk)
    ranges = data.mapInArrow(_ranges(bc), "tree_id int, node long, f int, lo double, hi double, n long, sy double, syy double")
    draw = hash_unit(F.concat_ws(":", "tree_id", "node", "f"), f"{seed}:et:{depth}")
    pdf = ranges.groupBy("tree_id", "node", "f").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.sum("sy").alias("sy"),
        F.sum("syy").alias("syy")).withColumn("draw", draw).toPandas()   # nodes × features cells, at most SLICE_CELLS
    bc.unpersist()
    at, f = cells(pdf)
    n, sy, syy = np.zeros(k), np.zeros(k), np.zeros(k)
    n[at], sy[at], syy[at] = pdf["n"], pdf["sy"], pdf["syy"]
    model.value[nodes] = sy / n
    if not may_split:
        return
    lo, hi, t = pdf["lo"].to_numpy(), pdf["hi"].to_numpy(), np.full((k, d), np.nan)
    with np.errstate(invalid="ignore"):
        t[at, f] = np.where(hi > lo, lo + pdf["draw"].to_numpy() * (hi - lo), np.nan)
    bc = sc.broadcast({**walk, "t": t})
    lefts = data.mapInArrow(_lefts(bc), "tree_id int, node long, f int, nl long, syl double, syyl double")
    pdf = lefts.groupBy("tree_id", "node", "f").agg(
        F.sum("nl").alias("nl"), F.sum("syl").alias("syl"), F.sum("syyl").alias("syyl")).toPandas()
    bc.unpersist()
    at, f = cells(pdf)
    n, sy, syy = n[at], sy[at], syy[at]
    nl, syl, syyl = (pdf[c].to_numpy() for c in ("nl", "syl", "syyl"))
    nr = n - nl
    sse = lambda c, s, q: q - s * s / c
    gain = np.full((k, d), -np.inf)
    with np.errstate(all="ignore"):
        g = sse(n, sy, syy) - sse(nl, syl, syyl) - sse(nr, sy - syl, syy - syyl)
    ok = (nl > 0) & (nr > 0) & (n >= min_samples_split) & (g > 0)
    gain[at[ok], f[ok]] = g[ok]
    best = gain.argmax(1)   # the first feature on ties
    rows = np.flatnonzero(gain[np.arange(k), best] > 0)
    feature[part.start + rows], threshold[part.start + rows] = best[rows], t[rows, best[rows]]


def _matrix(lists: pa.Array, d: int):
    """Rows of an Arrow list column as (numbers, whether missing); what is missing is NaN."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    x, missing = np.full((len(lists), d), np.nan), np.ones((len(lists), d), bool)
    inside = np.arange(d) < size[:, None]
    x[inside] = flat.to_numpy(zero_copy_only=False)
    missing[inside] = flat.is_null().to_numpy(zero_copy_only=False)
    return x, missing


def _members(x: np.ndarray, walk: dict):
    """(rows, their nodes in order, first row of each node) for every tree: rows that reach the pass's nodes."""
    feature, threshold, left, first = (walk[c] for c in ("feature", "threshold", "left", "first"))
    for tree in walk["trees"]:
        rows, node = np.arange(len(x)), np.full(len(x), tree)   # the first nodes are the roots
        for _ in range(walk["depth"]):
            f = feature[node]
            inner = f >= 0
            rows, node, f = rows[inner], node[inner], f[inner]
            node = left[node] + ~(x[rows, f] <= threshold[node])
        mine = (node >= first) & (node < first + len(walk["heap"]))
        rows, node = rows[mine], node[mine] - first
        if len(rows):
            order = np.argsort(node, kind="stable")
            rows, node = rows[order], node[order]
            yield rows, node, np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))


def _cell_rows(walk: dict, seen: np.ndarray, names: list[str], *columns: np.ndarray):
    """One row for each cell of the nodes that had rows in this task."""
    at, d = np.flatnonzero(seen), walk["d"]
    wide = [np.repeat(c[at], d) if c.ndim == 1 else c[at].ravel() for c in columns]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(walk["tree"][at], d).astype(np.int32)), pa.array(np.repeat(walk["heap"][at], d)),
         pa.array(np.tile(np.arange(d, dtype=np.int32), len(at))), *[pa.array(c) for c in wide]],
        ["tree_id", "node", "f", *names])


def _ranges(bc):
    def run(batches):
        walk = bc.value
        k, d = len(walk["heap"]), walk["d"]
        lo, hi = np.full((k, d), np.inf), np.full((k, d), -np.inf)
        n, sy, syy = np.zeros(k, np.int64), np.zeros(k), np.zeros(k)
        for batch in batches:
            x, missing = _matrix(batch.column(0), d)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            small, large = np.where(missing, np.inf, x), np.where(missing, -np.inf, x)
            for rows, node, first in _members(x, walk):
                at = node[first]
                lo[at] = np.minimum(lo[at], np.minimum.reduceat(small[rows], first, axis=0))
                hi[at] = np.maximum(hi[at], np.maximum.reduceat(large[rows], first, axis=0))
                n[at] += np.diff(np.concatenate((first, [len(rows)])))
                sy[at] += np.add.reduceat(y[rows], first)
                syy[at] += np.add.reduceat(y[rows] * y[rows], first)
        yield _cell_rows(walk, n > 0, ["lo", "hi", "n", "sy", "syy"], lo, hi, n, sy, syy)
    return run


def _lefts(bc):
    def run(batches):
        walk = bc.value
        t, d = walk["t"], walk["d"]
        nl, syl, syyl = np.zeros(t.shape, np.int64), np.zeros(t.shape), np.zeros(t.shape)
        for batch in batches:
            x, _ = _matrix(batch.column(0), d)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for rows, node, first in _members(x, walk):
                at = node[first]
                left, mine = x[rows] <= t[node], y[rows][:, None]
                nl[at] += np.add.reduceat(left, first, axis=0, dtype=np.int64)
                syl[at] += np.add.reduceat(np.where(left, mine, 0.0), first, axis=0)
                syyl[at] += np.add.reduceat(np.where(left, mine * mine, 0.0), first, axis=0)
        yield _cell_rows(walk, nl.any(1), ["nl", "syl", "syyl"], nl, syl, syyl)
    return run


# -------------------------------------------------------------- AdaBoost.R2

BINS, SAMPLE_ROWS = 32, 10_000   # MLlib's: bins of a feature, rows that candidate thresholds are drawn from
KEPT_ROUNDS = 8                  # rounds whose weights are worked out anew in each pass before rows are rewritten
PARTIAL_BYTES = 64 << 20         # tasks' sums that go straight to the driver
BLOCK_BYTES = 3 << 10            # bytes of a stored block; Arrow hands a worker 10,000 blocks at once by default
SLICE_ROWS = 1 << 16             # rows worked on at once
JOINT_CELLS = BINS ** 3          # combinations of bins whose sums one pass adds up


def ada_boost_r2(df: DataFrame, features: Sequence[str], y: str, n_estimators: int = 50,
                 learning_rate: float = 1.0, max_depth: int = 3, seed: int = 42,
                 key: str = "row_id") -> tuple[list, list[float]]:
    """Returns (trees, estimator weights); a tree is (feature, threshold, leaf value), see :func:`_walk`."""
    label = F.col(y).cast("double")
    store = TableStore(df.sparkSession)
    try:
        d = len(features)
        rows = store.write(df.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), label.alias("y"),
                                     F.xxhash64(key).alias("u")).mapInArrow(_pack_pass(d), BLOCKS), "rows-0")
        st = rows.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
        if not st["n"] or st["bad"]:
            raise ValueError("AdaBoost needs rows, and labels that are numbers")
        rows = _Weighted(store, rows, d, st["n"], learning_rate, seed)
        models, weights = [], []
        for m in range(n_estimators):
            tree = rows.fit_tree(max_depth)
            dmax, sw, swe = rows.errors(tree, m)
            if not dmax:
                models.append(tree)
                weights.append(1.0)
                break
            loss = swe / (dmax * sw)
            if loss >= 0.5:
                if not models:
                    models.append(tree)
                    weights.append(1.0)
                break
            beta = loss / (1.0 - loss)
            models.append(tree)
            weights.append(float(learning_rate * np.log(1.0 / beta)))
            if m + 1 < n_estimators:
                rows.reweight(tree, dmax, sw, beta)
        return models, weights
    finally:
        store.close()


class _Weighted:
    """Stored rows (x, y, w, u) and the rounds since they were stored; a row's weight is ``w`` times their factors.

    Weights only matter relative to each other: a round divides them by their sum.
    """

    def __init__(self, store: TableStore, rows: DataFrame, d: int, n: int, learning_rate: float, seed: int):
        self.store, self.d, self.n, self.rate, self.seed = store, d, n, learning_rate, seed
        self.recent: list[tuple] = []
        self.version, self.rows, self.parts = 0, rows.select("x", "y", "w", "u"), rows.rdd.getNumPartitions()
        self.splits = max(1, min(BINS, n)) - 1
        self.share = min(1.0, max(SAMPLE_ROWS, BINS * BINS) / n)
        self._take(self._run(None, -1))

    def _run(self, tree, m: int) -> list:
        schema = "dmax double, sw double, swe double, x binary, w binary, err binary"
        fn = _error_pass(self.d, self.recent, self.rate, tree, self.share, self.seed + m + 1)
        return self.rows.mapInArrow(fn, schema).collect()   # a row for each task, with about SAMPLE_ROWS rows in all

    def _take(self, found: list) -> None:
        x, w, err = (np.concatenate([np.frombuffer(r[c]) for r in found]) for c in ("x", "w", "err"))
        self.sample = x.reshape(-1, self.d), w, err

    def errors(self, tree, m: int) -> tuple[float, float, float]:
        """Largest error, sum of weights, weighted sum of errors; the pass also draws the rows of the next thresholds."""
        found = self._run(tree, m)
        self._take(found)
        return max(r["dmax"] for r in found), sum(r["sw"] for r in found), sum(r["swe"] for r in found)

    def reweight(self, tree, dmax: float, sw: float, beta: float) -> None:
        x, w, err = self.sample
        self.sample = x, _new_weight(w, err, dmax, sw, beta, self.rate), err
        self.recent.append((tree, dmax, sw, beta))
        if len(self.recent) < KEPT_ROUNDS:
            return
        old, self.version = self.version, self.version + 1
        self.rows = self.store.write(self.rows.mapInArrow(_weight_pass(self.d, self.recent, self.rate),
                                                          BLOCKS), f"rows-{self.version}").select("x", "y", "w", "u")
        self.recent, self.parts = [], self.rows.rdd.getNumPartitions()
        self.store.drop(f"rows-{old}")

    def fit_tree(self, max_depth: int) -> tuple:
        """The tree that MLlib's regression tree grows from these weights: variance gain over binned thresholds."""
        x, w, _ = self.sample
        cuts = [split_points(x[:, f], w, self.splits) for f in range(self.d)]
        inner, size = (1 << max_depth) - 1, (2 << max_depth) - 1
        feature, threshold, stats = np.zeros(inner, int), np.full(inner, np.inf), np.zeros((size, 4))
        grows = [0]   # nodes of the level that may split
        bins = tuple(len(c) + 1 for c in cuts)
        joint = self._joint(cuts, bins) if np.prod(bins, dtype=float) <= JOINT_CELLS else None
        boxes = {0: [(0, b) for b in bins]}   # bins of a node
        for level in range(max_depth):
            if not grows:
                break
            if joint is None:
                sums = self._level(feature, threshold, level, grows, cuts)
            else:
                sums = [_box_sums(joint, boxes[node]) for node in grows]
            if level == 0:
                stats[0] = sums[0][0].sum(0)
            nxt = []
            for node, cells in zip(grows, sums):
                best = _best_split(cells, cuts, stats[node])
                if best is None:
                    continue
                f, at, left, right = best
                lo, hi = boxes[node][f]
                boxes[2 * node + 1], boxes[2 * node + 2] = ([*boxes[node][:f], part, *boxes[node][f + 1:]]
                                                            for part in ((lo, at + 1), (at + 1, hi)))
                feature[node], threshold[node] = f, cuts[f][at]
                for child, s in ((2 * node + 1, left), (2 * node + 2, right)):
                    stats[child] = s
                    if level + 1 < max_depth and abs(_variance(s)) >= np.finfo(float).eps:
                        nxt.append(child)
            grows = nxt
        for node in range(inner):   # below a leaf both ways lead to its value
            if threshold[node] == np.inf:
                stats[2 * node + 1] = stats[2 * node + 2] = stats[node]
        leaves = stats[inner:]
        return feature, threshold, np.divide(leaves[:, 1], leaves[:, 0], out=np.zeros(len(leaves)), where=leaves[:, 0] > 0)

    def _joint(self, cuts: list, bins: tuple) -> np.ndarray:
        """Sums of w, wy, wyy and rows of every combination of bins, an axis for each feature."""
        cells = int(np.prod(bins))
        part = self.rows.mapInArrow(_joint_pass(self.d, self.recent, self.rate, cuts, bins), "at binary, sums binary")
        if self.parts * cells * 36 > PARTIAL_BYTES:
            part = part.repartition(max(1, int(self.parts ** 0.5))).mapInArrow(_add_cells(cells), "at binary, sums binary")
        total = np.zeros((cells, 4))
        for r in part.collect():   # at most PARTIAL_BYTES, or the square root of the tasks' sums
            total[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["sums"]).reshape(-1, 4)
        return total.reshape(*bins, 4)

    def _level(self, feature, threshold, level: int, nodes: list[int], cuts: list) -> np.ndarray:
        """(node, feature, bin) sums of w, wy, wyy and rows."""
        shape = (len(nodes), self.d, max(map(len, cuts)) + 1, 4)
        part = self.rows.mapInArrow(_level_pass(self.d, self.recent, self.rate, feature, threshold, level, nodes, cuts, shape),
                                    "sums binary")
        if self.parts * np.prod(shape) * 8 > PARTIAL_BYTES:
            part = part.repartition(max(1, int(self.parts ** 0.5))).mapInArrow(_add_sums, "sums binary")
        total = np.zeros(shape)
        for r in part.collect():   # at most PARTIAL_BYTES, or the square root of the tasks' sums
            total += np.frombuffer(r["sums"]).reshape(shape)
        return total


def split_points(values: np.ndarray, weights: np.ndarray, n_splits: int) -> np.ndarray:
    """Candidate thresholds of a feature as MLlib finds them: midway between neighbouring values, at most ``n_splits``
    at even steps of weight.  Missing values draw none."""
    known = ~np.isnan(values)
    values, inverse = np.unique(values[known], return_inverse=True)
    counts = np.bincount(inverse, weights=weights[known], minlength=len(values))
    middle = (values[:-1] + values[1:]) / 2.0
    if len(middle) <= n_splits:
        return middle
    stride = float(counts.sum()) / (n_splits + 1)
    kept, target, current = [], stride, float(counts[0])
    for i, c in enumerate(counts[1:].tolist()):
        previous, current = current, current + c
        if abs(previous - target) < abs(current - target):
            kept.append(i)
            target += stride
    return middle[kept]


def _variance(s):
    """Weighted variance of sums (w, wy, wyy, rows) in the last axis."""
    w = np.where(s[..., 0] > 0, s[..., 0], 1.0)
    return (s[..., 2] - s[..., 1] ** 2 / w) / w


def _box_sums(joint: np.ndarray, box: list) -> np.ndarray:
    """(feature, bin) sums of the rows whose bins lie in a box."""
    inside = joint[tuple(slice(lo, hi) for lo, hi in box)]
    out = np.zeros((len(box), max(joint.shape[:-1]), 4))
    for f, (lo, hi) in enumerate(box):
        out[f, lo:hi] = inside.sum(axis=tuple(g for g in range(len(box)) if g != f))
    return out


def _best_split(cells: np.ndarray, cuts: list, whole: np.ndarray):
    """(feature, threshold number, left sums, right sums) of greatest gain, the first on ties; None without a gain."""
    best, top, impurity = None, 0.0, _variance(whole)
    for f, cut in enumerate(cuts):
        if not len(cut):
            continue
        run = np.cumsum(cells[f], axis=0)
        left = run[:len(cut)]
        right = run[len(cut)] - left
        wl, wr = left[:, 0], right[:, 0]
        with np.errstate(invalid="ignore", divide="ignore"):
            gain = impurity - wl / (wl + wr) * _variance(left) - wr / (wl + wr) * _variance(right)
        gain = np.where((left[:, 3] >= 1) & (right[:, 3] >= 1) & (gain >= 0), gain, -np.inf)
        at = int(gain.argmax())
        if gain[at] > top:
            best, top = (f, at, left[at], right[at]), gain[at]
    return best


def _walk(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, levels: int) -> np.ndarray:
    """Node of every row after ``levels`` steps; node i has children 2i + 1 (x <= threshold) and 2i + 2.

    All paths have one length: a leaf above the last level has an infinite threshold and one value below it.
    """
    node, flat, base = np.zeros(len(x), np.int64), x.ravel(), np.arange(len(x)) * x.shape[1]
    for _ in range(levels):
        node = 2 * node + 2 - (flat[base + feature[node]] <= threshold[node])
    return node


def _leaf(x: np.ndarray, tree: tuple) -> np.ndarray:
    feature, threshold, value = tree
    return value[_walk(x, feature, threshold, len(value).bit_length() - 1) - len(feature)]


def _new_weight(w, err, dmax, sw, beta, rate):
    return w / sw * beta ** ((1.0 - err / dmax) * rate)


BLOCKS = "x binary, y binary, w binary, u binary, n int, bad int"


def _packed(x: np.ndarray, y: np.ndarray, w: np.ndarray, u: np.ndarray) -> pa.RecordBatch:
    """Rows as blocks of about ``BLOCK_BYTES``: the bytes of each column, their number and how many lack a label."""
    ends = np.append(np.arange(0, len(y), max(1, BLOCK_BYTES // (8 * (x.shape[1] + 3)))), len(y))

    def cut(v, width):
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * width).astype(np.int32)),
                                                                  pa.py_buffer(np.ascontiguousarray(v))])
    bad = np.add.reduceat(np.isnan(y), ends[:-1], dtype=np.int32) if len(y) else np.empty(0, np.int32)
    return pa.RecordBatch.from_arrays([cut(x, 8 * x.shape[1]), cut(y, 8), cut(w, 8), cut(u, 8), pa.array(np.diff(ends).astype(np.int32)),
                                       pa.array(bad)], ["x", "y", "w", "u", "n", "bad"])


def _numbers(blocks: pa.Array, dtype=np.float64) -> np.ndarray:
    """The bytes of all blocks of a column, which lie one after the other, as one array."""
    if not len(blocks):
        return np.empty(0, dtype)
    at = np.frombuffer(blocks.buffers()[1], np.int64 if pa.types.is_large_binary(blocks.type) else np.int32)
    lo, hi = int(at[blocks.offset]), int(at[blocks.offset + len(blocks)])
    return np.frombuffer(blocks.buffers()[2], dtype, (hi - lo) // 8, lo) if hi > lo else np.empty(0, dtype)


def _pack_pass(d: int):
    def run(batches):
        for batch in batches:
            x, _ = _matrix(batch.column(0), d)
            y = pc.fill_null(batch.column(1), np.nan).to_numpy(zero_copy_only=False)
            yield _packed(x, y, np.ones(len(y)), batch.column(2).to_numpy())
    return run


def _weighed(batches, d: int, recent: list, rate: float):
    """Stored rows by slices: features, label, present weight, hash of the key."""
    for batch in batches:
        xs, ys, ws = (_numbers(batch.column(i)) for i in range(3))
        xs, us = xs.reshape(-1, d), _numbers(batch.column(3), np.int64)
        for lo in range(0, len(ys), SLICE_ROWS):
            x, y, w, u = (v[lo:lo + SLICE_ROWS] for v in (xs, ys, ws, us))
            for tree, dmax, sw, beta in recent:
                w = _new_weight(w, np.abs(y - _leaf(x, tree)), dmax, sw, beta, rate)
            yield x, y, w, u


def _weight_pass(d: int, recent: list, rate: float):
    def run(batches):
        for x, y, w, u in _weighed(batches, d, recent, rate):
            yield _packed(x, y, w, u)
    return run


def _error_pass(d: int, recent: list, rate: float, tree, share: float, seed: int):
    """A task's largest error, Σw, Σw·err, and its rows that the round's seed draws for the next thresholds."""
    def run(batches):
        dmax = sw = swe = 0.0
        drawn = []
        for x, y, w, u in _weighed(batches, d, recent, rate):
            err = np.abs(y - _leaf(x, tree)) if tree else np.zeros(len(y))
            dmax, sw, swe = max(dmax, float(err.max(initial=0.0))), sw + float(w.sum()), swe + float(w @ err)
            mine = slice(None) if share >= 1 else _uniform(u, seed) < share
            drawn.append((x[mine], w[mine], err[mine]))
        sample = [np.concatenate(c).tobytes() for c in zip(*drawn)] or [b""] * 3
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (dmax, sw, swe)] + [pa.array([s], pa.binary()) for s in sample],
                                         ["dmax", "sw", "swe", "x", "w", "err"])
    return run


def _uniform(u: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each hash and seed."""
    z = u.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53


def _level_pass(d: int, recent: list, rate: float, feature, threshold, level: int, nodes: list[int], cuts: list, shape: tuple):
    place = np.full((2 << level) - 1, -1)
    place[nodes] = np.arange(len(nodes))

    def run(batches):
        cells = shape[0] * shape[2]
        total = np.zeros((d, 4, cells))
        for x, y, w, _ in _weighed(batches, d, recent, rate):
            at = place[_walk(x, feature, threshold, level)]
            if (at < 0).any():
                x, y, w, at = (v[at >= 0] for v in (x, y, w, at))
            wy = w * y
            wyy = wy * y
            for f in range(d):
                cell = at * shape[2] + np.searchsorted(cuts[f], x[:, f])
                for j, v in enumerate((w, wy, wyy, None)):
                    total[f, j] += np.bincount(cell, weights=v, minlength=cells)
        sums = total.reshape(d, 4, shape[0], shape[2]).transpose(2, 0, 3, 1)
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(sums).tobytes()], pa.binary())], ["sums"])
    return run


def _joint_pass(d: int, recent: list, rate: float, cuts: list, bins: tuple):
    def run(batches):
        size = int(np.prod(bins))
        total = np.zeros((4, size))
        for x, y, w, _ in _weighed(batches, d, recent, rate):
            cell = np.zeros(len(y), np.int64)
            for f in range(d):
                cell = cell * bins[f] + np.searchsorted(cuts[f], x[:, f])
            wy = w * y
            for j, v in enumerate((w, wy, wy * y, None)):
                total[j] += np.bincount(cell, weights=v, minlength=size)
        yield _cell_sums(total.T)
    return run


def _cell_sums(total: np.ndarray):
    """A record of the cells that have rows."""
    at = np.flatnonzero(total[:, 3])
    return pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()], pa.binary()),
                                       pa.array([np.ascontiguousarray(total[at]).tobytes()], pa.binary())], ["at", "sums"])


def _add_cells(cells: int):
    def run(batches):
        total = np.zeros((cells, 4))
        for batch in batches:
            for at, v in zip(*batch.columns):
                total[np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(v.as_buffer()).reshape(-1, 4)
        yield _cell_sums(total)
    return run


def _add_sums(batches):
    total = None
    for batch in batches:
        for v in batch.column(0):
            v = np.frombuffer(v.as_buffer())
            total = v.copy() if total is None else total + v
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def ada_predict(df: DataFrame, features: Sequence[str], models: list, weights: list[float],
                key: str = "row_id") -> DataFrame:
    """Weighted median of the round predictions (per row, vectorised)."""
    bc = df.sparkSession.sparkContext.broadcast((models, np.asarray(weights, float)))

    @F.pandas_udf("double")
    def wmedian(*columns: pd.Series) -> pd.Series:
        trees, w = bc.value
        x = np.column_stack([s.to_numpy(float) for s in columns])
        p = np.column_stack([_leaf(x, t) for t in trees])
        order = np.argsort(p, axis=1)
        cdf = np.cumsum(w[order], axis=1)
        idx = (cdf >= 0.5 * cdf[:, -1:]).argmax(axis=1)
        return pd.Series(p[np.arange(len(p)), order[np.arange(len(p)), idx]])

    return df.select(key, wmedian(*[F.col(c).cast("double") for c in features]).alias("prediction"))


def ada_nodes(models: list, weights: list[float]) -> pd.DataFrame:
    """Node table of the rounds, one tree each, with the estimator weights."""
    parts = []
    for i, (feature, threshold, value) in enumerate(models):
        inner, size = len(feature), len(feature) + len(value)
        node, up = np.arange(size), np.zeros(len(value))
        leaf = node >= inner
        parts.append(pd.DataFrame({
            "tree_id": i, "node_id": node, "feature": np.concatenate((feature, np.full(len(value), -1))),
            "threshold": np.concatenate((threshold, up)), "left": np.where(leaf, -1, 2 * node + 1),
            "right": np.where(leaf, -1, 2 * node + 2), "value": np.concatenate((np.zeros(inner), value)),
            "is_leaf": leaf, "weight": weights[i]}))
    return pd.concat(parts, ignore_index=True)


# ---------------------------------------------------------- RBF regression

def rbf_regression(df: DataFrame, features: str, y: str, C: float = 1.0, gamma: float = 0.1,
                   epsilon: float = 0.1, n_features: int = 128, iters: int = 100, seed: int = 42,
                   key: str = "row_id"):
    """M33 (declared approximation): ε-insensitive linear fit on random Fourier features.

    Targets are standardised for the fit and mapped back for prediction.  Each
    subgradient step is one aggregate returning a D-vector.
    """
    from .kernel import random_fourier_features
    z = random_fourier_features(df.select(key, features, y), features, gamma, n_features, seed, out="__z")
    z = materialize(z.select(key, "__z", F.col(y).cast("double").alias("__y")))
    st = z.agg(F.avg("__y").alias("m"), F.stddev_pop("__y").alias("s"), F.count(F.lit(1)).alias("n")).first()
    mu, sd, n = st["m"], (st["s"] or 1.0), st["n"]
    w = np.zeros(n_features)
    b = 0.0
    sc = df.sparkSession.sparkContext
    m1, v1 = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for it in range(1, iters + 1):
        bw = sc.broadcast((w, b))

        def grad(batches):
            ww, bb = bw.value
            g = np.zeros(len(ww) + 1)
            for pdf in batches:
                zz = np.stack(pdf["__z"].to_numpy())
                r = (pdf["__y"].to_numpy() - mu) / sd - (zz @ ww + bb)
                act = np.abs(r) > epsilon
                s = np.sign(r) * act
                g[:-1] -= zz.T @ s
                g[-1] -= s.sum()
            yield pd.DataFrame({"g": [g]})

        parts = z.select("__z", "__y").mapInPandas(grad, "g array<double>")
        # one D+1 vector per partition; summed on the driver (bounded by partitions × D)
        g = np.sum([np.array(r["g"]) for r in parts.collect()], axis=0)
        g = np.concatenate([w, [0.0]]) + C * g / n
        m1 = 0.9 * m1 + 0.1 * g
        v1 = 0.999 * v1 + 0.001 * g * g
        step = 0.05 * (m1 / (1 - 0.9 ** it)) / (np.sqrt(v1 / (1 - 0.999 ** it)) + 1e-8)
        w = w - step[:-1]
        b = b - step[-1]
        bw.unpersist()
    return {"w": w, "b": b, "mu": mu, "sd": sd, "gamma": gamma, "n_features": n_features, "seed": seed}


def rbf_predict(df: DataFrame, features: str, model: dict, key: str = "row_id") -> DataFrame:
    from .kernel import random_fourier_features
    z = random_fourier_features(df.select(key, features), features, model["gamma"], model["n_features"],
                                model["seed"], out="__z")
    w = F.array(*[F.lit(float(v)) for v in model["w"]])
    dot = F.aggregate(F.zip_with("__z", w, lambda a, c: a * c), F.lit(0.0), lambda acc, v: acc + v)
    return z.select(key, ((dot + F.lit(model["b"])) * F.lit(model["sd"]) + F.lit(model["mu"])).alias("prediction"))


def extra_trees_predict(df: DataFrame, features: str, nodes: DataFrame, key: str = "row_id") -> DataFrame:
    return ensemble_predict(df, nodes, features, key)
