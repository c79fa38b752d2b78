"""SimHash near duplicates by multi-index hashing.

A fingerprint has one bit for each of 64 bits of the XXH64 hashes of a text's
shingles (repeats included): it is 1 if more than half of the hashes have it.
Two fingerprints link when they differ in at most ``RADIUS`` = 4 bits.

1. Equal fingerprints become one entry, under their smallest id; minima are
   pre-aggregated, so a fingerprint that a third of all rows hold costs one row per task.
2. Fingerprints are cut into two segments of 32 bits.  At a distance of 4 or
   less the upper segments differ in at most two bits or the lower ones in at
   most one.  Every fingerprint is entered in a table under the 33 keys of the
   ball of radius 1 around each segment.  Balls around segments that differ in
   two bits or less share keys; one of them is the pair's own, so a pair is
   fetched once, and its complete distance is checked inside the join.
3. A key with more than ``CROWD`` entries does not emit its pairs, whose number
   grows with the square of the group.  The fingerprints under such keys are
   entered under all 2,081 points at distance 2 or less in 64 bits: those that share a
   point differ in at most 4 bits, and every two that differ in at most 4 share
   one.  Linking each entry of a point to its smallest therefore gives the
   same components with a number of links in proportion to the fingerprints.
4. Components by star contraction.

Edge cases: a null, empty or blank text has fingerprint zero and links like any other;
fewer words than a shingle are one shingle; a null id keeps its row, links with nothing and
has a null component; repeated rows give equal rows; extra columns are not
read; an empty table gives an empty result.  A text is read in pieces of
CHUNK_BYTES, so a task holds one Arrow batch and one piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, settle
from .components import components
from .words import text_column, word_chunks

N = 4
SEED = 42
RADIUS = 4
HALF = 32
CROWD = 256
HEAVY = 1000   # at most this many fingerprints can hold more than one row in HEAVY each


def _shingle_hashes(data: bytes, n: int):
    """Arrays of the 64-bit hashes of all shingles of a text, repeats included."""
    digest, tail, some = xxhash.xxh64_intdigest, [], False
    for words in word_chunks(data):
        words = tail + words
        if len(words) < n:
            tail = words
            continue
        runs = zip(*(words[k:] for k in range(n)), strict=False)
        yield np.array([digest(b" ".join(x), SEED) for x in runs], dtype=">u8")
        tail, some = words[len(words) - n + 1:], True
    if tail and not some:
        yield np.array([digest(b" ".join(tail), SEED)], dtype=">u8")


def fingerprint(data: bytes, n: int = N) -> int:
    """Unsigned 64-bit fingerprint of a text in UTF-8; ASCII letters count as lower case."""
    ones, total = np.zeros(64, np.int64), 0
    for h in _shingle_hashes(data.lower(), n):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        total += len(h)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) of every row: a map without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts, _ = text_column(batch.column(1))
            found = np.fromiter((fingerprint(x.as_buffer().to_pybytes(), n) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fp long")


def _upper(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, HALF)


def _lower(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit((1 << HALF) - 1))


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def entries(fps: DataFrame) -> DataFrame:
    """``half, key, fp``: the table of every fingerprint under the balls of radius 1 around its segments."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(HALF)))
    listed = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("half")).select(
        "fp", "half", F.when(F.col("half") == 0, _upper(F.col("fp"))).otherwise(_lower(F.col("fp"))).alias("segment"),
        F.explode(flips).alias("flip"))
    return listed.select("half", F.col("segment").bitwiseXOR(F.col("flip")).alias("key"), "fp")


def table_links(table: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of linked fingerprints that meet in the table, once each.

    Spark sizes the table like its fingerprints, without the 66 entries of each,
    and would send it to the driver and every executor: the hint rules that out.
    """
    x, y = table.alias("x"), table.hint("merge").alias("y")
    a, b = F.col("x.fp"), F.col("y.fp")
    upper = _upper(a).bitwiseXOR(_upper(b))
    # the key at which a pair counts: for upper segments one differing bit is taken from a, for lower ones it is b's own
    lowest = upper.bitwiseAND(-upper)
    own = F.when(F.col("x.half") == 0, F.col("x.key") == _upper(a).bitwiseXOR(lowest)).otherwise(
        (F.col("x.key") == _lower(b)) & (F.bit_count(upper) > 2))
    return x.join(y, (F.col("x.half") == F.col("y.half")) & (F.col("x.key") == F.col("y.key")) & (a < b)
                  & (_differ(a, b) <= radius) & own).select(a.alias("a"), b.alias("b"))


def crowd_links(fps: DataFrame) -> DataFrame:
    """Links to the smallest fingerprint of every shared point at distance RADIUS / 2 or less: the same components.

    The hint is that of ``table_links``: a fingerprint has 2,081 points.
    """
    masks = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    flips = F.array(*(F.lit(_signed(m)).cast("long") for m in masks))
    points = fps.select("fp", F.explode(flips).alias("flip")).select(
        F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "fp")
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("point", "a")
    return points.join(least.hint("merge"), "point").where("a < fp").select("a", F.col("fp").alias("b")).distinct()


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, crowd: int = CROWD) -> DataFrame:
    """``id_col, fingerprint, component_id`` of every row."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(fingerprints(docs, id_col, text_col, n), "rows")
    filled = rows.where("doc_id IS NOT NULL")
    groups = scratch.write(filled.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")),
                           "groups")
    fps = groups.select("fp")
    table = entries(fps)
    crowded = scratch.write(table.groupBy("half", "key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > crowd)
                            .select("half", "key"), "crowded")
    settle(docs.sparkSession)
    if crowded.isEmpty():
        met = table_links(table)
    else:
        dense = scratch.write(table.join(crowded, ["half", "key"], "left_semi").select("fp").distinct(), "dense")
        met = table_links(table.join(crowded, ["half", "key"], "left_anti")).union(crowd_links(dense))
    met = scratch.write(met, "met")
    settle(docs.sparkSession)
    names = groups.select("fp", "node")
    links = (met.join(names.withColumnsRenamed({"fp": "a", "node": "na"}), "a")
             .join(names.withColumnsRenamed({"fp": "b", "node": "nb"}), "b")
             .select(F.col("na").alias("a"), F.col("nb").alias("b")))
    placed = components(links, scratch, "placed").withColumnRenamed("component", "linked")
    final = scratch.write(groups.join(placed, "node", "left").select(
        "fp", F.coalesce("linked", "node").alias("component"), "copies"), "final")
    # fingerprints with more than one row in HEAVY are at most HEAVY: their rows need no shuffle
    total = filled.count()
    heavy = final.where(F.col("copies") * HEAVY > total).select("fp", F.col("component").alias("heavy"))
    first = filled.join(F.broadcast(heavy), "fp", "left")
    rest = first.where("heavy IS NULL").join(final.select("fp", "component"), "fp").select("doc_id", "fp", "component")
    kind = docs.schema[id_col].dataType
    out = (rest.union(first.where("heavy IS NOT NULL").select("doc_id", "fp", "heavy"))
           .union(rows.where("doc_id IS NULL").select("doc_id", "fp", F.lit(None).cast(kind))))
    return out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.col("component").alias("component_id"))
