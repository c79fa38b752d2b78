"""Line deduplication with content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines chooses chunk boundaries,
so inserted or deleted lines move only the boundaries next to them.  A boundary
stands after line i when the hash of lines i-1 and i is 0 modulo ``MEAN_LINES``
and the same does not hold for lines i-2 and i-1; every chunk of a text with two
or more lines has at least two.  Below these chunks lie the smallest ones, which
overlap: from every line that holds a word to the next such line, with the empty
lines between.  Chunks of both kinds found at several places are removed
everywhere but at the first place (smallest document id, then position).  The
hash only proposes: places count as equal when their bytes are equal.

A passage of two or more lines with words that also stands earlier goes as a
whole, whatever lies around it: its smallest chunks cover it from its first to
its last line with a word, so matches need no further extension.  Empty lines at
its ends go only with a larger chunk.  A single line that repeats without a
repeated neighbour is no chunk and stays.

Edge cases: null and empty texts and texts of one line have no chunk and stay
(null becomes the empty text); chunks with fewer than two lines that hold a word
are left alone; a null id sorts before all others; rows that repeat an id and a
text are one document and give equal rows; other columns are kept; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, RollingHash, mix64, slices_by_bytes, take_ragged
from .repeats import TextBatch, covered, later_places, per_document, repeated, with_spans

MEAN_LINES = 3
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def lines_of(data: np.ndarray, offsets: np.ndarray):
    """(document, start, end) of every line of concatenated documents; empty documents have one empty line."""
    feeds = np.flatnonzero(data == 10)
    n = len(offsets) - 1
    doc = np.concatenate((np.arange(n), np.searchsorted(offsets, feeds, side="right") - 1))
    start = np.concatenate((offsets[:-1], feeds + 1))
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    end = np.empty_like(start)
    end[:-1] = np.where(doc[1:] == doc[:-1], start[1:] - 1, offsets[1:][doc[:-1]])
    if len(end):
        end[-1] = offsets[-1]
    return doc, start, end


def chunks(data: np.ndarray, offsets: np.ndarray, hasher: RollingHash):
    """Chunks of concatenated documents: (document, first line, line after the last, hash, first byte, end byte)."""
    doc, start, end = lines_of(data, offsets)
    n = len(doc)
    if n == 0:
        return (np.empty(0, np.int64),) * 6
    h = hasher.span(hasher.prefix(data), start, end)
    ink = np.concatenate(([0], np.cumsum(~_SPACE[data])))
    words = (ink[end] > ink[start]).astype(np.int64)
    same = np.zeros(n, bool)       # line i has a line before it in its document
    same[1:] = doc[1:] == doc[:-1]
    hit = np.zeros(n, bool)
    hit[1:] = same[1:] & (mix64(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:]) % U64(MEAN_LINES) == 0)
    cut = hit.copy()
    cut[1:] &= ~hit[:-1]
    # two more lines must follow in the document
    more = np.zeros(n, bool)
    more[:-2] = (doc[:-2] == doc[2:])
    cut &= more
    begins = np.zeros(n, bool)
    begins[0] = True
    begins[1:] = cut[:-1] | ~same[1:]
    first = np.flatnonzero(begins)
    stop = np.concatenate((first[1:], [n]))
    inked = np.add.reduceat(words, first)
    inner = words.astype(bool)
    # a chunk from one line with words to the next is also one of the smallest chunks
    ok = (stop - first >= 2) & (inked >= 2) & ~((inked == 2) & inner[first] & inner[stop - 1])
    at = np.flatnonzero(inner)
    near = doc[at[1:]] == doc[at[:-1]]
    f = np.concatenate((first[ok], at[:-1][near]))
    s = np.concatenate((stop[ok], at[1:][near] + 1))
    if not len(f):
        return (np.empty(0, np.int64),) * 6
    # hash of a chunk: sum of its line hashes, each scaled by its place in the chunk
    size = s - f
    inside = take_ragged(np.arange(n), f, size)
    place = (inside - np.repeat(f, size)).astype(U64)
    scaled = mix64(h[inside] + place * U64(0xC2B2AE3D27D4EB4F))
    key = mix64(np.add.reduceat(scaled, np.cumsum(size) - size) + size.astype(U64))
    line = np.arange(n) - np.searchsorted(doc, doc)
    return doc[f], line[f], line[f] + size, key, start[f], end[s - 1]


def _chunk_rows(with_bytes: bool):
    names = ["h", "doc_id", "t", "pos", "stop"] + ["bytes"] * with_bytes

    def run(batches):
        hasher = RollingHash(47)
        for batch in batches:
            whole = TextBatch(batch.column(1))
            wanted = batch.column(2) if with_bytes else None
            for lo, hi in slices_by_bytes(whole.offsets, SLICE_BYTES):
                offsets = whole.offsets[lo:hi + 1] - whole.offsets[lo]
                data = whole.data[whole.offsets[lo]:whole.offsets[hi]]
                doc, a, b, key, at, end = chunks(data, offsets, hasher)
                if with_bytes and len(doc):
                    ask = [{(s["pos"], s["stop"]) for s in x} for x in wanted.slice(lo, hi - lo).to_pylist()]
                    keep = np.fromiter(((p, q) in ask[d] for d, p, q in zip(doc.tolist(), a.tolist(), b.tolist())),
                                       bool, len(doc))
                    doc, a, b, key, at, end = (x[keep] for x in (doc, a, b, key, at, end))
                if not len(doc):
                    continue
                digests = TextBatch(batch.column(1).slice(lo, hi - lo)).digests()
                out = [pa.array(key.view(np.int64)), batch.column(0).slice(lo, hi - lo).take(pa.array(doc)),
                       pa.array(digests[doc]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))]
                if with_bytes:
                    out.append(pa.array([data[x:y].tobytes() for x, y in zip(at.tolist(), end.tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names)
    return run


def _cut(batches):
    names = ["doc_id", "text", "n_lines", "n_removed", "row"]
    for batch in batches:
        texts = TextBatch(batch.column(1))
        out, total, gone = [], [], []
        for i, spans in enumerate(batch.column(2).to_pylist()):
            data = texts.document(i)
            if not spans:
                out.append(data.tobytes().decode())
                total.append(int((data == 10).sum()) + 1)
                gone.append(0)
                continue
            lines = data.tobytes().split(b"\n")
            mask = covered(len(lines), [s["pos"] for s in spans], [s["stop"] for s in spans])
            out.append(b"\n".join(x for x, m in zip(lines, mask.tolist()) if not m).decode())
            total.append(len(lines))
            gone.append(int(mask.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
             batch.column(3)], names)


def removals(docs: DataFrame) -> DataFrame:
    """Line ranges to remove: ``doc_id, t, pos, stop``, after comparing bytes.

    Only hashes and places of chunks are shuffled for all documents; bytes travel
    for chunks whose hash repeats.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    part = docs.select("doc_id", "text")
    rows = part.mapInArrow(_chunk_rows(False), f"h long, doc_id {kind}, t long, pos int, stop int")
    likely = rows.join(repeated(rows, ["h"]).select("h"), "h", "left_semi")
    asked = with_spans(part, per_document(likely, "pos", "stop"), "inner").select("doc_id", "text", "spans")
    exact = asked.mapInArrow(_chunk_rows(True), f"h long, doc_id {kind}, t long, pos int, stop int, bytes binary")
    return later_places(exact, ["h", "bytes"])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, cleaned ``text``, n_lines and n_removed of every row."""
    return _cleaned(docs, id_col, text_col, F.lit(None).cast("int")).drop("row").withColumnRenamed("doc_id", id_col)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the cleaned text; rows that lose all their words go."""
    row = F.struct(*[docs[c] for c in docs.columns])
    cleaned = _cleaned(docs, id_col, text_col, row).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cleaned.select(*[
        F.when(F.col("n_removed") > 0, F.col("text")).otherwise(F.col("row")[c]).alias(c) if c == text_col
        else F.col("row")[c].alias(c) for c in docs.columns])


def _cleaned(docs: DataFrame, id_col: str, text_col: str, row) -> DataFrame:
    part = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row.alias("row"))
    kind, kept = (part.schema[c].dataType.simpleString() for c in ("doc_id", "row"))
    joined = with_spans(part, per_document(removals(part), "pos", "stop"), "left")
    return joined.select("doc_id", "text", "spans", "row").mapInArrow(
        _cut, f"doc_id {kind}, text string, n_lines long, n_removed long, row {kept}")
