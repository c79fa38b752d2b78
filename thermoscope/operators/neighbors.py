"""Exact nearest neighbours by a tree of pivots, at any number of rows.

* **Copies first.**  Rows with equal vectors become one entry with its count and its ``k + 1`` smallest keys.  Counts and
  ranks are cut down in every task before the shuffle, so a vector that a third of all rows share costs one entry.
* **Tree.**  A node of more than ``leaf`` entries is split at ``FANOUT`` of its own entries (a hash sample); entries go to
  the nearest, and every child keeps its pivot and radius.  One pass a level, until no node is larger than a leaf.
  Equal vectors are one entry, so every split parts something.  Small children of a node share a leaf while they fit.
* **Search.**  An entry first searches its own leaf; the distance of its k-th neighbour there bounds what else can
  matter.  It then goes down the tree into every child with ``d(x, pivot) - radius`` up to that bound
  (triangle inequality), and meets the members of the leaves it reaches.  Where nothing can be ruled out (many
  dimensions), that is every leaf, so leaves are large: a vector is sent once a leaf, not once a few hundred members.
* **Inside a group** boxes of some dozen to some hundred rows, halved along the widest coordinate, are visited in order
  of their gaps, until the gap exceeds the k-th distance.
* **Groups of a fixed size.**  Members of a leaf number at most ``leaf``.  Entries that reach a leaf, or a
  node whose pivots are not broadcast, are dealt to chunks of about ``leaf`` by hash, each with its own copy of the members or pivots.
  Pivots are broadcast only while they take at most ``BROADCAST_BYTES``.

Products of vectors only propose: what is kept is measured by differences, with room for the rounding of the products.
Ties go to the smaller key.  Keys are unique; null vectors are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import TableStore, shuffle_partitions

FANOUT = 16
LEAF = 16384
BROADCAST_BYTES = 32 << 20
SLICE = 512
CHUNK = 4096      # members met at once inside a group
FEW = 4           # coordinates up to which boxes are small


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in column], float) if len(column) else np.empty((0, 1))


def _dist(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "chebyshev":
        d = np.abs(a[:, :1] - b[:, 0][None, :])
        for j in range(1, a.shape[1]):
            np.maximum(d, np.abs(a[:, j:j + 1] - b[:, j][None, :]), out=d)
        return d
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _paired(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of paired rows from their differences."""
    diff = a - b
    return np.abs(diff).max(1) if metric == "chebyshev" else np.sqrt((diff * diff).sum(1))


def _room(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """More than the rounding of :func:`_dist`: for products about the root of machine precision times the largest norms."""
    if metric == "chebyshev":
        return 1e-13 * (np.abs(a).max(1) + (np.abs(b).max() if len(b) else 0.0))
    return 4e-8 * (1.0 + np.sqrt((a * a).sum(1)) + (np.sqrt((b * b).sum(1)).max() if len(b) else 0.0))


def _boxes(x: np.ndarray, size: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An order of the rows and its stretches of at most ``size`` rows, halved along the widest coordinate."""
    order, todo, done = np.arange(len(x)), [(0, len(x))], []
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= size:
            done.append((lo, hi))
            continue
        part = x[order[lo:hi]]
        half = (hi - lo) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(part[:, np.argmax(part.max(0) - part.min(0))], half)]
        todo += [(lo, lo + half), (lo + half, hi)]
    return order, sorted(done)


def _nearest(qx, qid, mx, mid, k: int, metric: str, bound: np.ndarray | None = None) -> pd.DataFrame:
    """``q, dist, nb``: the k nearest members of every query in order of (distance, key), itself excluded.

    With ``bound`` only members up to a query's bound count; queries without any are left out.
    """
    if not len(qid) or not len(mid):
        return pd.DataFrame({"q": [], "dist": [], "nb": []}, dtype=object)
    few = mx.shape[1] <= FEW
    order, cells = _boxes(mx, 64 if few else SLICE)
    mx, mid = mx[order], mid[order]
    starts = np.array([a for a, _ in cells])
    ends = np.array([b for _, b in cells])
    low, high = np.minimum.reduceat(mx, starts), np.maximum.reduceat(mx, starts)
    slack = 2 * _room(qx, mx, metric)
    qorder, qcells = _boxes(qx, 64 if few else SLICE)
    per_step = max(1, CHUNK // int((ends - starts).max()))
    first = min(per_step, -(-4 * (k + 1) // int((ends - starts).min()))) if few else per_step
    ids_out, dist_out, nb_out = [], [], []
    for a, b in qcells:
        at = qorder[a:b]
        x, ids, more = qx[at], qid[at], slack[at]
        u = np.full(len(at), np.inf) if bound is None else bound[at].astype(float)
        gap = np.maximum(0.0, np.maximum(low - x.max(0), x.min(0) - high))
        gap = gap.max(1) if metric == "chebyshev" else np.sqrt((gap * gap).sum(1))
        near = np.argsort(gap, kind="stable")
        gap = gap[near]
        q, dist, nb = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        done, step = 0, first
        while done < len(near):
            left = np.flatnonzero(u + more >= gap[done])   # gaps ascend: the others have met all that matters
            if not len(left):
                break
            cells = near[done:min(done + step, int(np.searchsorted(gap, (u + more)[left].max(), side="right")))]
            done, step = done + len(cells), min(per_step, 2 * step)
            if few:   # a box that no query of its own reaches is passed over
                out = np.maximum(0.0, np.maximum(low[cells] - x[left][:, None], x[left][:, None] - high[cells]))
                reach = (out.max(2) if metric == "chebyshev" else np.sqrt((out * out).sum(2))) <= (u + more)[left][:, None]
                left, cells = left[reach.any(1)], cells[reach.any(0)]
                if not len(cells):
                    continue
            pick = np.concatenate([np.arange(starts[c], ends[c]) for c in cells])
            m = mx[pick]
            d = _dist(x[left], m, metric)
            top = u[left]
            if d.shape[1] > k and np.isinf(top).any():   # one more than k: a query may meet itself
                top = np.minimum(top, np.partition(d, k, axis=1)[:, k] + more[left])
            qi, mi = np.nonzero(d <= (top + more[left])[:, None])
            qi = left[qi]
            other = ids[qi] != mid[pick[mi]]
            qi, mi = qi[other], mi[other]
            if not len(qi):
                continue
            far = _paired(x[qi], m[mi], metric)
            some = far <= u[qi]
            q, dist, nb = np.concatenate((q, qi[some])), np.concatenate((dist, far[some])), np.concatenate((nb, mid[pick[mi[some]]]))
            by = np.lexsort((nb, dist, q))
            q, dist, nb = q[by], dist[by], nb[by]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            q, dist, nb = q[keep], dist[keep], nb[keep]
            count = np.bincount(q, minlength=len(at))
            last = np.cumsum(count) - 1
            full = count == k
            u[full] = np.minimum(u[full], dist[last[full]])
        if len(q):
            found, place = np.unique(q, return_index=True)
            ids_out.append(ids[found])
            dist_out += np.split(dist, place[1:])
            nb_out += np.split(nb, place[1:])
    if not ids_out:
        return pd.DataFrame({"q": [], "dist": [], "nb": []}, dtype=object)
    return pd.DataFrame({"q": np.concatenate(ids_out), "dist": dist_out, "nb": nb_out})


FOUND = "q long, dist array<double>, nb array<long>"


def entries(df: DataFrame, features: str, key: str, k: int) -> DataFrame:
    """``key, x, copies, keys``: one row per vector, under its smallest key, with its k + 1 smallest keys."""
    rows = df.where(F.col(features).isNotNull()).select(F.col(key).cast("long").alias("key"),
                                                        F.col(features).cast("array<double>").alias("x"))
    counted = rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    # a rank with a limit is cut in every task before the shuffle
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("key"))).where(F.col("r") <= k + 1)
    some = first.groupBy("x").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    return counted.join(some, "x").select(F.get("keys", F.lit(0)).alias("key"), "x", "copies", "keys")


class PivotTree:
    """Entries in leaves, and the children of every split node by level."""

    def __init__(self, points: DataFrame, store: TableStore, leaf: int = LEAF, seed: int = 42, metric: str = "euclidean"):
        self.spark, self.store, self.leaf, self.seed, self.metric = points.sparkSession, store, leaf, seed, metric
        self.levels: list[DataFrame] = []
        self.width = len(points.select("x").first()["x"]) if not points.isEmpty() else 0
        pts = store.write(points.select("key", "x", F.lit(0).cast("long").alias("node")), "points-0")
        large = self._large(pts)
        while not large.isEmpty():
            pts, large = self._split(pts, large, len(self.levels))
        self.points = pts

    def _large(self, pts: DataFrame) -> DataFrame:
        return pts.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > self.leaf)

    def _split(self, pts: DataFrame, large: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        store, metric, leaf = self.store, self.metric, self.leaf
        large = store.write(large, f"large-{level}")
        place = F.pmod(F.xxhash64("key", F.lit(self.seed + level)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        inside = pts.join(large, "node")
        # some four times as many rows as pivots are expected below the threshold, the smallest hashes become pivots
        drawn = inside.where(place * F.col("size") < 4.0 * FANOUT).groupBy("node").agg(
            F.slice(F.array_sort(F.collect_list(F.struct(place.alias("h"), F.col("x")))), 1, FANOUT).alias("p"))
        pivots = store.write(drawn.select("node", F.transform("p", lambda s: s["x"]).alias("pivots")), f"pivots-{level}")

        def nearest(rows: pd.DataFrame, pivots_of) -> pd.DataFrame:
            x = _matrix(rows["x"])
            j, d = np.zeros(len(rows), np.int64), np.zeros(len(rows))
            for node, at in rows.groupby("node").indices.items():
                p = pivots_of(node)["pivots"]
                for lo in range(0, len(at), SLICE):
                    part = at[lo:lo + SLICE]
                    near = _dist(x[part], p, metric).argmin(1)
                    j[part], d[part] = near, _paired(x[part], p[near], metric)
            return pd.DataFrame({"key": rows["key"], "x": rows["x"], "node": rows["node"], "j": j, "d": d})

        # a node whose sample came out empty waits for the next level's hash
        moved = self._with_nodes(inside.join(pivots.select("node"), "node", "left_semi").select("key", "x", "node"), pivots, nearest,
                                 "key long, x array<double>, node long, j long, d double", "key")
        moved = store.write(moved, f"moved-{level}")
        size = store.write(moved.groupBy("node", "j").agg(F.max("d").alias("radius"), F.count(F.lit(1)).alias("size"))
                           .groupBy("node").applyInPandas(lambda pdf: _packed(pdf, leaf),
                                                          "node long, j long, pack long, radius double, size long")
                           .withColumn("child", F.xxhash64("node", "pack")), f"sizes-{level}")
        moved = moved.join(size.select("node", "j", "child"), ["node", "j"])
        flat = pivots.select("node", F.posexplode("pivots").alias("j", "pivot"))
        children = flat.join(size, ["node", "j"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct(
            "child", "radius", (F.col("size") > self.leaf).alias("inner"), "pivot"))).alias("c"))
        self.levels.append(store.write(children.select(
            "node", F.transform("c", lambda s: s["child"]).alias("child"), F.transform("c", lambda s: s["radius"]).alias("radius"),
            F.transform("c", lambda s: s["inner"]).alias("inner"), F.transform("c", lambda s: s["pivot"]).alias("pivots")),
            f"children-{level}"))
        stay = pts.join(pivots.select("node"), "node", "left_anti").select("key", "x", "node")
        fresh = store.write(stay.union(moved.select("key", "x", F.col("child").alias("node"))), f"points-{level + 1}")
        for name in (f"points-{level}", f"moved-{level}", f"large-{level}"):
            store.drop(name)
        return fresh, self._large(fresh)

    def _with_nodes(self, rows: DataFrame, nodes: DataFrame, fn, schema: str, key: str) -> DataFrame:
        """``fn(rows, node -> its arrays)`` over rows and the table of their nodes."""
        leaf = self.leaf
        if nodes.count() * FANOUT * (self.width + 4) * 8 <= BROADCAST_BYTES:
            held = {r["node"]: _arrays(r.asDict()) for r in nodes.collect()}
            bc = self.spark.sparkContext.broadcast(held)

            def run(batches):
                for pdf in batches:
                    if len(pdf):
                        out = fn(pdf, bc.value.__getitem__)
                        if len(out):
                            yield out
            return rows.mapInPandas(run, schema)
        sizes = rows.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / leaf).cast("int").alias("chunks"))
        dealt = rows.join(sizes, "node").withColumn("chunk", F.pmod(F.xxhash64(key), F.col("chunks")).cast("int"))
        copies = nodes.join(sizes, "node").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))) \
            .withColumnRenamed("node", "at").withColumnRenamed("chunk", "part")

        def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame()
            own = _arrays(right.iloc[0].to_dict())
            return fn(left, lambda _: own)

        names = [f.split()[0] for f in schema.split(", ")]

        def safe(left, right):
            out = both(left, right)
            return out if len(out.columns) else pd.DataFrame({c: [] for c in names})
        return dealt.drop("chunks").groupBy("node", "chunk").cogroup(copies.drop("chunks").groupBy("at", "part")) \
            .applyInPandas(safe, schema)

    def visits(self, queries: DataFrame) -> DataFrame:
        """``q, leaf`` of every leaf but its own that a query (q, x, u, own) must search."""
        metric = self.metric
        if sum(c.count() for c in self.levels) * FANOUT * (self.width + 4) * 8 <= BROADCAST_BYTES:
            return self._visits_at_once(queries)
        frontier, found = queries.withColumn("node", F.lit(0).cast("long")), None
        schema = "q long, x array<double>, u double, own long, node long, inner boolean"

        def descend(rows: pd.DataFrame, arrays_of) -> pd.DataFrame:
            x, u, own = _matrix(rows["x"]), rows["u"].to_numpy(float), rows["own"].to_numpy()
            out = []
            for node, at in rows.groupby("node").indices.items():
                a = arrays_of(node)
                for lo in range(0, len(at), SLICE):
                    part = at[lo:lo + SLICE]
                    near = _dist(x[part], a["pivots"], metric) - a["radius"][None, :] <= (
                        u[part] + 2 * _room(x[part], a["pivots"], metric))[:, None]
                    near &= a["inner"][None, :] | (a["child"][None, :] != own[part][:, None])
                    i, c = np.nonzero(near)
                    if len(i):
                        out.append(pd.DataFrame({"q": rows["q"].to_numpy()[part[i]], "x": rows["x"].to_numpy()[part[i]],
                                                 "u": u[part[i]], "own": own[part[i]], "node": a["child"][c],
                                                 "inner": a["inner"][c]}))
            return pd.concat(out) if out else pd.DataFrame({"q": [], "x": [], "u": [], "own": [], "node": [], "inner": []})

        # a node may stay whole for a level; then its rows wait in the frontier until the level that splits it
        for level, children in enumerate(self.levels):
            here = frontier.join(children.select("node"), "node", "left_semi")
            wait = frontier.join(children.select("node"), "node", "left_anti")
            step = self.store.write(self._with_nodes(here, children, descend, schema, "q"), f"visit-{level}")
            done = step.where("NOT inner").select("q", "x", F.col("node").alias("leaf"))
            found = done if found is None else found.union(done)
            frontier = step.where("inner").drop("inner").select(*queries.columns, "node").union(
                wait.select(*queries.columns, "node"))
        return found.select("q", "leaf").distinct()

    def _visits_at_once(self, queries: DataFrame) -> DataFrame:
        """Down the whole broadcast tree in one pass over the queries."""
        metric = self.metric
        bc = self.spark.sparkContext.broadcast({r["node"]: _arrays(r.asDict()) for c in self.levels for r in c.toLocalIterator()})

        def descend(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                x, u, own, ids = _matrix(pdf["x"]), pdf["u"].to_numpy(float), pdf["own"].to_numpy(), pdf["q"].to_numpy()
                todo, qs, leaves = [(0, np.arange(len(pdf)))], [], []
                while todo:
                    node, at = todo.pop()
                    a = bc.value[node]
                    near = _dist(x[at], a["pivots"], metric) - a["radius"][None, :] <= (
                        u[at] + 2 * _room(x[at], a["pivots"], metric))[:, None]
                    inner = a["inner"].astype(bool)
                    todo += [(int(a["child"][c]), at[near[:, c]]) for c in np.flatnonzero(inner) if near[:, c].any()]
                    i, c = np.nonzero(near & ~inner[None, :] & (a["child"][None, :] != own[at][:, None]))
                    qs.append(ids[at[i]])
                    leaves.append(a["child"][c])
                out = pd.DataFrame({"q": np.concatenate(qs), "leaf": np.concatenate(leaves)}).drop_duplicates()
                if len(out):
                    yield out

        return queries.select("q", "x", "u", "own").mapInPandas(descend, "q long, leaf long")


def _packed(children: pd.DataFrame, leaf: int) -> pd.DataFrame:
    """Children of one node (at most ``FANOUT``): neighbours in order share a leaf while they fit, ``pack`` is its first."""
    children, pack, fill = children.sort_values("j"), [], leaf + 1
    for j, size in zip(children["j"], children["size"]):
        if size > leaf:
            pack.append(j)
            continue
        if fill + size > leaf:
            first, fill = j, 0
        fill += size
        pack.append(first)
    return children.assign(pack=pack)[["node", "j", "pack", "radius", "size"]]


def _arrays(row: dict) -> dict:
    return {k: (_matrix(v) if k == "pivots" else np.asarray(v)) for k, v in row.items() if k in ("pivots", "child", "radius", "inner")}


def _leaf_search(tree: PivotTree, queries: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """The k nearest of every (query, leaf) up to the query's bound, in groups of about ``leaf`` queries and one leaf's members."""
    chunks = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / tree.leaf).cast("int").alias("chunks"))
    dealt = visits.join(chunks, "leaf").withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("chunks")).cast("int")).drop("chunks") \
        .join(queries.select("q", "x", "u"), "q")
    members = tree.points.select(F.col("key").alias("m"), F.col("x").alias("mx"), F.col("node").alias("at")) \
        .join(chunks.withColumnRenamed("leaf", "at"), "at") \
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    metric = tree.metric

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _nearest(_matrix(left["x"]), left["q"].to_numpy(), _matrix(right["mx"]), right["m"].to_numpy(), k, metric,
                        left["u"].to_numpy(float))

    # groups are few bytes and much work: their number of tasks is fixed, not merged by size
    tasks = shuffle_partitions(tree.spark)
    return dealt.repartition(tasks, "leaf", "chunk").groupBy("leaf", "chunk").cogroup(
        members.repartition(tasks, "at", "part").groupBy("at", "part")).applyInPandas(search, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """``q, near``: the k best (dist, nb) of every query; it has at most k from each leaf it reached."""
    return found.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("dist", "nb")))), 1, k).alias("near"))


def knn(df: DataFrame, k: int, features: str = "features", key: str = "row_id", leaf: int = LEAF, seed: int = 42,
        report: dict | None = None, metric: str = "euclidean") -> DataFrame:
    """``key, neighbor, dist, rank``: the exact k nearest other rows of every row.

    ``metric`` is euclidean or chebyshev (the largest difference of a coordinate).
    ``report`` receives rows, entries, levels, leaves and the comparisons per entry.
    """
    from .decompose import origin
    store = TableStore(df.sparkSession)
    x = F.col(features).cast("array<double>")
    if metric == "euclidean":   # distances do not change; products stay small
        x = F.zip_with(x, F.lit(origin(df, features)[0]), lambda a, b: a - b)
    elif metric != "chebyshev":
        raise ValueError(metric)
    moved = df.where(F.col(features).isNotNull()).select(F.col(key).cast("long").alias(key), x.alias(features))
    ent = store.write(entries(moved, features, key, k), "entries")
    tree = PivotTree(ent, store, leaf, seed, metric)

    def own(key_, pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _matrix(pdf["x"]), pdf["key"].to_numpy()
        return _nearest(x, ids, x, ids, k, metric)

    first = store.write(tree.points.repartition(shuffle_partitions(tree.spark), "node").groupBy("node").applyInPandas(
        lambda pdf: own(None, pdf), FOUND), "own")
    found = first
    if tree.levels:
        bound = first.select("q", F.when(F.size("dist") >= k, F.element_at("dist", -1)).otherwise(F.lit(float("inf"))).alias("u"))
        queries = tree.points.join(bound, F.col("key") == F.col("q"), "left").select(
            F.col("key").alias("q"), "x", F.coalesce("u", F.lit(float("inf"))).alias("u"), F.col("node").alias("own"))
        visits = store.write(tree.visits(queries), "visits")
        found = first.union(_leaf_search(tree, queries, visits, k))
    near = store.write(_best(found, k), "near")
    if report is not None:
        sizes = tree.points.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        own_pairs = sizes.agg(F.sum(F.col("n") * F.col("n")), F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
        more = visits.groupBy("leaf").count().join(sizes, F.col("leaf") == F.col("node")).agg(
            F.sum(F.col("count") * F.col("n"))).first()[0] if tree.levels else 0
        report.update(entries=own_pairs[2], leaves=own_pairs[1], largest=own_pairs[3], levels=len(tree.levels),
                      comparisons=((own_pairs[0] or 0) + (more or 0)) / max(1, own_pairs[2] or 0))
    # from entries to rows: an entry's own copies come first, then the keys of its neighbours
    listed = near.select("q", F.explode("near").alias("s")).select("q", "s.dist", F.col("s.nb").alias("nb"))
    listed = listed.join(ent.select(F.col("key").alias("nb"), F.col("keys")), "nb").select("q", "dist", "keys")
    same = ent.where("copies > 1").select(F.col("key").alias("q"), F.lit(0.0).alias("dist"), "keys")
    lists = listed.union(same).select("q", "dist", F.explode("keys").alias("nb")).groupBy("q").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("dist", "nb"))), 1, k + 1).alias("near"))
    rows = moved.select(F.col(key).alias("row"), F.col(features).alias("x")).join(
        ent.select(F.col("key").alias("q"), F.col("x")), "x").join(lists, "q")
    mine = F.slice(F.filter("near", lambda s: s["nb"] != F.col("row")), 1, k)
    return rows.select(F.col("row").alias(key), F.posexplode(mine).alias("place", "s")).select(
        key, F.col("s.nb").alias("neighbor"), F.col("s.dist").alias("dist"), (F.col("place") + 1).alias("rank"))
