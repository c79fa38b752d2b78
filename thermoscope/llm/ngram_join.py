"""N-gram Jaccard join with rare-first prefix filtering.

Texts are sets of distinct ``N``-word shingles of 64-bit hashes (ASCII letters
lower-cased; a text with fewer words is one shingle).  Two texts link when
``100 * shared >= PERCENT * union``.

1. One pass counts the shingles in a table of 2**SKETCH_BITS buckets over all
   documents (a bounded size whatever the corpus) and gives every document its
   set size, a 128-bit digest of the set and the sizes of its set in HIST
   ranges of hash values.  Equal sets collapse to one representative.
2. A set is ordered rarest first: by bucket count, then by hash.  Two sets that
   link share a shingle among the first ``n - need + 1`` of each, where ``need``
   is the overlap that their sizes ask for; only these prefixes meet in a join
   on the shingle.  Length, prefix and positional filters apply inside the
   join, and each pair survives once, at its first common shingle.
3. Suffix filter: the overlap cannot exceed the sum of the smaller sizes over
   the HIST ranges.
4. The texts of the surviving pairs alone become sets again, and each pair is
   intersected once.

A shingle that stands in the prefixes of more than ``HOT`` sets does not emit
its pairs at first: ``HUB_ROUNDS`` times, one member per shingle is compared with
the others, which links large groups of near copies; afterwards only pairs that
are still in different components meet on such shingles.  No link between
components is lost.

Edge cases: null and empty texts have an empty set and link with nothing; a null
id is its own row with a null component; rows that repeat an id count as one
document; repeated rows give equal rows; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, RollingHash, Scratch, mix64, settle, slices_by_bytes
from .components import components
from .repeats import TextBatch

N = 4
PERCENT = 85
SKETCH_BITS = 18
HIST = 32
HOT = 8
HUB_ROUNDS = 2
SLICE_BYTES = 2 << 20
FAN_IN = 16
BROADCAST_IDS = 1_000_000   # ids of candidate texts are broadcast only up to this many

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(data: np.ndarray, offsets: np.ndarray, n: int, hasher: RollingHash):
    """(document, hash) of the distinct shingles of concatenated texts, sorted by both."""
    data = _LOWER[data]
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = ink.copy()
    begins[1:] &= ~ink[:-1] | edge[1:-1]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, U64)
    doc = np.searchsorted(offsets, start, side="right") - 1
    word = hasher.span(hasher.prefix(data), start, end)
    first = np.searchsorted(doc, doc)                        # first word of the document
    count = np.searchsorted(doc, doc, side="right") - first  # its words
    k = np.arange(len(doc)) - first
    size = np.minimum(count, n)
    at = np.flatnonzero(k + size <= count)
    h = np.zeros(len(at), U64)
    for j in range(n):
        live = size[at] > j
        nxt = np.minimum(at + j, len(word) - 1)
        h = np.where(live, mix64(h * U64(0x9E3779B97F4A7C15) + word[nxt] + U64(j + 1)), h)
    d = doc[at]
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[keep], h[keep]


def _slices(batch, n: int, hasher: RollingHash):
    """(first row, rows, document, hash) of byte-bounded parts of an Arrow batch."""
    whole = TextBatch(batch.column(1))
    for lo, hi in slices_by_bytes(whole.offsets, SLICE_BYTES):
        offsets = whole.offsets[lo:hi + 1] - whole.offsets[lo]
        d, h = shingles(whole.data[whole.offsets[lo]:whole.offsets[hi]], offsets, n, hasher)
        yield lo, hi - lo, d, h


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - SKETCH_BITS)).astype(np.int64)


def _ragged(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    bounds = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))


def _describe(n: int):
    names = ["doc_id", "n", "f1", "f2", "hist", "sketch"]

    def run(batches):
        hasher, counts, kind = RollingHash(53), np.zeros(1 << SKETCH_BITS, np.int64), None
        for batch in batches:
            kind = batch.column(0).type
            for lo, rows, d, h in _slices(batch, n, hasher):
                counts += np.bincount(_bucket(h), minlength=len(counts))
                size = np.bincount(d, minlength=rows)
                f = []
                for salt in (0x8CB92BA72F3D8DD7, 0xD1B54A32D192ED03):
                    sums = np.concatenate(([U64(0)], np.cumsum(mix64(h + U64(salt)), dtype=U64)))
                    ends = np.cumsum(size)
                    f.append((sums[ends] - sums[ends - size]).view(np.int64))
                hist = np.bincount(d * HIST + (h % U64(HIST)).astype(np.int64), minlength=rows * HIST)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), pa.array(size.astype(np.int64)), pa.array(f[0]), pa.array(f[1]),
                     _ragged(hist.astype(np.int32), np.full(rows, HIST)), pa.nulls(rows, pa.binary())], names)
        if kind is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kind), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                 pa.nulls(1, pa.list_(pa.int32())), pa.array([counts.tobytes()], pa.binary())], names)
    return run


def _add_up(batches):
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for x in batch.column(0):
            total += np.frombuffer(x.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sketch"])


def bucket_ranks(described: DataFrame, scratch: Scratch) -> np.ndarray:
    """One byte per bucket that grows with its count; per-task tables are added up in a tree on the executors."""
    part = described.where("n < 0").select("sketch")
    left, k = part.count(), 0
    while left > FAN_IN:
        left, k = -(-left // FAN_IN), k + 1
        part = scratch.write(part.repartition(left).mapInArrow(_add_up, "sketch binary"), f"sketch-{k}")
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in part.collect():  # at most FAN_IN rows of fixed size, or as many as partitions of one more round
        total += np.frombuffer(r["sketch"], np.int64)
    return np.minimum(255, 6 * np.log2(1.0 + total)).astype(np.uint8)


def need(na: Column, nb: Column, percent: int) -> Column:
    """Overlap from which sets of these sizes link: ceil(percent * (na + nb) / (100 + percent))."""
    return F.floor((percent * (na + nb) + 99 + percent) / F.lit(100 + percent)).cast("long")


def _prefixes(n: int, percent: int, ranks_b):
    def run(batches):
        hasher = RollingHash(53)
        for batch in batches:
            for lo, rows, d, h in _slices(batch, n, hasher):
                order = np.lexsort((h, ranks_b.value[_bucket(h)], d))
                h = h[order]
                size = np.bincount(d, minlength=rows)
                pos = np.arange(len(d)) - (np.cumsum(size) - size)[d]
                # the longest prefix any partner can ask for: the smallest partner has percent % of the size
                longest = size - -(-percent * size // 100) + 1
                keep = pos < longest[d]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), pa.array(size.astype(np.int64)),
                     _ragged(h[keep].view(np.int64), np.bincount(d[keep], minlength=rows))], ["doc_id", "n", "prefix"])
    return run


def _sets(n: int):
    def run(batches):
        hasher = RollingHash(53)
        for batch in batches:
            for lo, rows, d, h in _slices(batch, n, hasher):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), _ragged(h.view(np.int64), np.bincount(d, minlength=rows))],
                    ["node", "set"])
    return run


def _pairs(a: DataFrame, b: DataFrame, percent: int, more: Column) -> DataFrame:
    """Pairs that share a prefix shingle and pass the length, prefix and positional filters, once each.

    ``a`` and ``b`` have key, node, n, pos.
    """
    x, y = a.alias("x"), b.alias("y")
    nx, ny, px, py = F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos")
    least = need(nx, ny, percent)
    rest = F.least(nx - px, ny - py)
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & more
                 & (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny))
                 & (px <= nx - least) & (py <= ny - least) & (F.least(px, py) + rest >= least))
    swap = F.col("x.node") > F.col("y.node")
    side = lambda c: (F.when(swap, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")),
                      F.when(swap, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")))
    (na, nb), (ia, ib), (pa_, pb) = side("node"), side("n"), side("pos")
    once = met.select(na.alias("a"), nb.alias("b"), ia.alias("na"), ib.alias("nb"), pa_.alias("pa"), pb.alias("pb")) \
        .groupBy("a", "b", "na", "nb").agg(F.min(F.struct("pa", "pb")).alias("p"))
    # nothing is shared before the first common shingle
    return once.where(F.least(F.col("na") - F.col("p.pa"), F.col("nb") - F.col("p.pb"))
                      >= need(F.col("na"), F.col("nb"), percent)).select("a", "b", "na", "nb")


def _suffix_filter(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets could share enough, by the sizes of their parts in HIST ranges."""
    h = nodes.select("node", "hist")
    p = (pairs.join(h.withColumnsRenamed({"node": "a", "hist": "ha"}), "a")
         .join(h.withColumnsRenamed({"node": "b", "hist": "hb"}), "b"))
    top = F.aggregate(F.zip_with("ha", "hb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return p.where(top >= need(F.col("na"), F.col("nb"), percent)).select("a", "b", "na", "nb")


def _overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Linked (a, b): the exact overlap of the two sets of each pair."""
    p = (pairs.join(sets.withColumnsRenamed({"node": "a", "set": "sa"}), "a")
         .join(sets.withColumnsRenamed({"node": "b", "set": "sb"}), "b"))
    return p.where(F.size(F.array_intersect("sa", "sb")) >= need(F.col("na"), F.col("nb"), percent)).select("a", "b")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N,
         percent: int = PERCENT) -> DataFrame:
    """``id_col, n_shingles, component_id`` of every row."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    part = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    described = scratch.write(part.mapInArrow(
        _describe(n), f"doc_id {kind}, n long, f1 long, f2 long, hist array<int>, sketch binary"), "described")
    ranks_b = spark.sparkContext.broadcast(bucket_ranks(described, scratch))
    rows = described.where("n >= 0").drop("sketch")
    filled = rows.where("n > 0 AND doc_id IS NOT NULL")
    groups = scratch.write(filled.groupBy("f1", "f2", "n").agg(
        F.min("doc_id").alias("node"), F.first("hist").alias("hist")), "groups")
    nodes = groups.select("node", "n", "hist")

    listed = part.where("doc_id IS NOT NULL").mapInArrow(
        _prefixes(n, percent, ranks_b), f"doc_id {kind}, n long, prefix array<long>")
    # prefixes and counts are stored on their own, so that the shuffle of the counts is gone before that of the entries
    listed = scratch.write(listed.join(groups.select(F.col("node").alias("doc_id"), "n"), ["doc_id", "n"], "left_semi"), "listed")
    entries = listed.select(F.col("doc_id").alias("node"), "n", F.posexplode("prefix").alias("pos", "key"))
    counts = scratch.write(entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "counts")
    # the kept shingle before each one: where two sets have it in common too, they have met there already
    before = Window.partitionBy("node").orderBy("pos", "key")
    entries = scratch.write(entries.join(counts, "key").withColumn("prev", F.lag("key").over(before)), "entries")
    for t in ("listed", "counts"):
        scratch.drop(t)
    usual, hot = entries.where(F.col("m") <= HOT).drop("m"), entries.where(F.col("m") > HOT).drop("m")

    settle(spark)

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Verify candidate pairs: only the texts of surviving pairs are turned into sets."""
        left = scratch.write(_suffix_filter(pairs, nodes, percent), f"{name}-pairs")
        ids = scratch.write(left.select(F.col("a").alias("doc_id")).union(left.select("b")).distinct(), f"{name}-ids")
        few = ids.count() <= BROADCAST_IDS
        texts = part.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
        sets = scratch.write(texts.mapInArrow(_sets(n), f"node {kind}, set array<long>"), f"{name}-sets")
        out = scratch.write(_overlaps(left, sets, percent), name)
        for t in ("pairs", "ids", "sets"):
            scratch.drop(f"{name}-{t}")
        settle(spark)
        return out

    # one side of a pair is the smaller node, and a run of common shingles counts at its first, so a pair
    # is made once in most cases
    fresh = (F.col("x.node") < F.col("y.node")) & (F.col("x.prev").isNull() | F.col("y.prev").isNull()
                                                   | (F.col("x.prev") != F.col("y.prev")))
    links = linked(_pairs(usual, usual, percent, fresh), "links")
    if not hot.isEmpty():
        for r in range(HUB_ROUNDS):
            pick = F.struct(F.xxhash64("node", F.lit(r)) if r else F.col("n") * 0, "node", "n", "pos")
            hubs = hot.groupBy("key").agg(F.min(pick).alias("p")).select("key", "p.node", "p.n", "p.pos")
            links = links.union(linked(_pairs(hubs, hot, percent, F.col("x.node") != F.col("y.node")), f"hub-{r}"))
        so_far = components(links, scratch, "part")
        placed = hot.join(so_far, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # shingles whose sets are all in one component are settled
        mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
            .where("lo <> hi").select("key")
        placed = scratch.write(placed.join(mixed, "key", "left_semi"), "placed")
        rest = _pairs(placed, placed, percent, fresh & (F.col("x.component") != F.col("y.component")))
        links = links.union(linked(rest, "rest"))
    linked_nodes = components(links, scratch, "all")
    final = groups.join(linked_nodes, "node", "left").select(
        "f1", "f2", "n", F.coalesce("component", "node").alias("component"))
    out = rows.select("doc_id", "f1", "f2", "n").join(final, ["f1", "f2", "n"], "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N,
               percent: int = PERCENT) -> DataFrame:
    """The rows of every group of linked documents under its smallest id, with all columns.

    Equal rows of one id and text count once; texts that share an id all stay, and so do rows without an id.
    """
    mine, text = (f"_{uuid.uuid4().hex}" for _ in range(2))   # names that no column of the documents has
    first = link(docs, id_col, text_col, n, percent).where(F.col("component_id") == F.col(id_col)) \
        .select(F.col(id_col).alias(mine)).distinct()
    kept = docs.join(first, F.col(id_col) == F.col(mine), "left_semi").withColumn(text, F.sha2(text_col, 256))
    return kept.dropDuplicates([id_col, text]).drop(text).union(docs.where(F.col(id_col).isNull()))
