"""Steps shared by the operators that remove repeated passages.

A passage row is ``(key columns, doc_id, t, pos, ...)``: ``t`` is a digest of the
document's text, so rows that share an id but not a text stay apart, and rows
that repeat an id and a text count as one document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACE = ("doc_id", "t", "pos")


def text_digest(col):
    """32-bit digest of a text (null counts as empty)."""
    return F.crc32(F.coalesce(col, F.lit("")).cast("binary"))


def digest_of(data: bytes) -> int:
    return zlib.crc32(data)


def place():
    return F.struct("doc_id", "pos", "t")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First place of every key found at two or more places.

    Minimum and maximum place are pre-aggregated before the shuffle, so a key
    that holds a third of all rows sends one row per task.
    """
    return (rows.groupBy(*keys).agg(F.min(place()).alias("first"), F.max(place()).alias("last"))
            .where(F.col("first") < F.col("last")).select(*keys, "first"))


def later_places(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key also has an earlier place (smaller id, then smaller position)."""
    return rows.join(repeated(rows, keys), keys).where(place() > F.col("first")).drop("first", *keys)


def per_document(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per document with the list of its passages (at most one per position)."""
    return rows.groupBy("doc_id", "t").agg(F.collect_set(F.struct(*columns)).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Join documents (``doc_id``, ``text``, anything else) with their passage lists."""
    s = spans.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "spans")
    return docs.withColumn("t", text_digest(F.col("text"))).join(
        s, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")), how).drop("_d", "_t")


class TextBatch:
    """Bytes, offsets and digests of the string column of an Arrow batch (null counts as empty)."""

    def __init__(self, column: pa.Array):
        text = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(text)
        if n:
            raw = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + n + 1]
            buf = text.buffers()[2]
            data = np.frombuffer(buf, np.uint8) if buf is not None else np.empty(0, np.uint8)
            self.data = data[int(raw[0]):int(raw[-1])]
            self.offsets = raw - raw[0]
        else:
            self.data, self.offsets = np.empty(0, np.uint8), np.zeros(1, np.int64)
        self.n = n

    def document(self, i: int) -> np.ndarray:
        return self.data[self.offsets[i]:self.offsets[i + 1]]

    def digests(self) -> np.ndarray:
        return np.array([zlib.crc32(self.document(i)) for i in range(self.n)], np.int64)


def covered(n: int, starts, ends) -> np.ndarray:
    """Mark positions 0..n-1 that lie in any [start, end)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:n]) > 0


def runs_of(mask: np.ndarray) -> int:
    """Number of maximal runs of true values."""
    return int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
