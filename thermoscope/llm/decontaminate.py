"""Benchmark decontamination by size-partitioned MinHash containment search.

Texts are sets of distinct ``N``-word shingles (lower case; a text with fewer
words is one shingle).  An item is contained in a document when at least
``SHARE`` percent of its shingles are among the document's.

Search: items are partitioned by the size of their sets into classes that double
in width.  A class with largest set u sketches each of its items by the
floor((100 - SHARE) * u / 100) + 1 shingles with the smallest hashes (a bottom-k
MinHash sketch).  An item that is contained misses fewer shingles than its
sketch holds, so at least one sketch shingle is in the document, however long the
document is: the search has no false negatives, unlike a comparison of two
fixed-length sketches.  A document shingle is looked up only if its hash does
not exceed the largest sketch hash of all classes.

Verification: documents that share a sketch shingle are shingled again, and the
distinct shingles they share with each item are counted by text.

Edge cases: null and empty texts have no shingles and match nothing; a document
with fewer than ``N`` words has its whole sequence as one shingle; an item with
fewer than ``N`` words is therefore not searched inside longer texts; items with
equal shingle sets are searched once and reported under every item id; a null
id is passed through; repeated document rows give one result; extra columns are
not read; with no items or no documents the result is empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

N = 5
SHARE = 80
BLANKS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANKS), "")


def _places(w: Column, n: int) -> Column:
    """Start of every shingle of a word array; a short text has one, an empty one none."""
    return F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))) \
        .otherwise(F.array().cast("array<int>"))


def shingle_hashes(w: Column, n: int = N) -> Column:
    # words past the end of a short text are null and do not change the hash
    return F.transform(_places(w, n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))


def shingle_texts(w: Column, n: int = N) -> Column:
    return F.transform(_places(w, n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))


def item_shingles(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(set_id, n, h, shingle) of the distinct sets, and (set_id, item_id) of all items.

    ``set_id`` is a digest of the sorted set, so equal items are searched once.
    """
    sets = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).select(
        "item_id", F.array_sort(F.array_distinct(shingle_texts(F.col("w")))).alias("s")).where(F.size("s") > 0)
    sets = sets.withColumn("set_id", F.sha2(F.array_join("s", "\n"), 256))
    members = sets.select("set_id", "item_id").distinct()
    rows = sets.groupBy("set_id").agg(F.first("s").alias("s")).select(
        "set_id", F.size("s").alias("n"), F.explode("s").alias("shingle"))
    h = F.xxhash64(*[F.get(F.split("shingle", " "), k) for k in range(N)])
    return rows.withColumn("h", h), members


def sketches(rows: DataFrame, share: int = SHARE) -> DataFrame:
    """Bottom-k sketch of every item; k follows from the largest set of its size class."""
    classed = rows.withColumn("size_class", F.floor(F.log2("n")))
    largest = F.pow(F.lit(2), F.col("size_class") + 1) - 1
    k = F.floor(F.lit(100 - share) * largest / 100) + 1
    order = F.row_number().over(Window.partitionBy("set_id").orderBy("h"))
    return classed.withColumn("r", order).where(F.col("r") <= k).select("set_id", "h")


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_id_col: str = "item_id", item_text_col: str = "text", share: int = SHARE) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) of every item contained in a document."""
    scratch = Scratch(docs.sparkSession)
    rows, members = item_shingles(items, item_id_col, item_text_col)
    rows = scratch.write(rows, "items")
    members = scratch.write(members, "members")
    sketch = scratch.write(sketches(rows, share).select("h").distinct(), "sketch")
    top = sketch.agg(F.max("h")).first()[0]
    part = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hashed = part.select("doc_id", words(F.col("text")).alias("w")).select(
        "doc_id", F.explode(shingle_hashes(F.col("w"))).alias("h"))
    if top is not None:
        hashed = hashed.where(F.col("h") <= top)
    likely = scratch.write(hashed.join(sketch, "h", "left_semi").select("doc_id").distinct(), "likely")
    again = part.join(likely.withColumnRenamed("doc_id", "_d"), F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    texts = again.select("doc_id", words(F.col("text")).alias("w")).select(
        "doc_id", F.explode(F.array_distinct(shingle_texts(F.col("w")))).alias("shingle"))
    shared = (texts.join(rows.select("set_id", "n", "shingle"), "shingle")
              .groupBy("doc_id", "set_id", "n").agg(F.count_distinct("shingle").alias("n_shared"))
              .where(100 * F.col("n_shared") >= share * F.col("n")))
    return shared.join(members, "set_id").select(
        "doc_id", "item_id", F.col("n").cast("long").alias("n_item"), "n_shared")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """Documents without those that contain an item; all columns are kept."""
    own = f"_{uuid.uuid4().hex}"   # a name that no column of the documents has
    hit = contained(docs, items, id_col=id_col, **names).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(hit, F.col(id_col).eqNullSafe(F.col(own)), "left_anti")
