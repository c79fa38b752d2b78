"""Substring deduplication by sliding spans of sentences.

Every shortest run of consecutive sentences is hashed, from each sentence forward
and from each sentence backward: runs of ``RUN`` or more sentences with at least
``MIN_WORDS`` words, and shorter runs with at least ``PAIR_WORDS``.  A sentence of
more than ``PAIR_WORDS`` words is cut into units at words whose hash is smallest
among ``NEAR`` neighbours, so that a run of the second kind can begin and end
inside it.  The runs of all documents meet on their 128-bit hash; all units
covered by a run that also stands at an earlier place (smaller document id, then
earlier in the text) are removed.

So a repeated passage goes as a whole when it consists of whole sentences and has
``PAIR_WORDS`` words, or ``RUN`` sentences and ``MIN_WORDS`` words.  Of a passage
of over 50 words inside longer sentences at most ``NEAR`` words at each end stay.

A sentence ends after ``.``, ``!`` or ``?`` or their like in other scripts (closing
quotes and brackets included) before white space, after a full-width stop, or at a
line feed.  It owns the white space that follows it.  Words are what white space
separates; in scripts written without blanks every character counts as one.

Edge cases: null and empty texts have no sentences and give an empty text; a
null id sorts before all others; rows that repeat an id and a text are one
document and give equal rows; other columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, RollingHash, Scratch, give_back, settle, slices_by_bytes
from .repeats import TextBatch, covered, later_places, per_document, runs_of, with_spans

RUN = 3
MIN_WORDS = 8
PAIR_WORDS = 30
SLICE_BYTES = 1 << 20

NEAR = 11

SPACE, STOP, CLOSE, FULL, WIDE, MARK = 1, 2, 4, 8, 16, 32
_KIND = np.zeros(0x110000, np.uint8)
_KIND[0x3001:0x3040] = _KIND[0xFF01:0xFF10] = _KIND[0xFF1A:0xFF21] = MARK
for _kind, _chars in ((SPACE, "\t\n\x0b\x0c\r "), (STOP, ".!?\u061f\u06d4\u0964\u0965\u1362"), (FULL, "\u3002\uff01\uff1f\uff61"),
                      (CLOSE, "\"')]}\u2019\u201d\u300d\u300f\u3011\u300b\uff09")):
    _KIND[[ord(c) for c in _chars]] |= _kind
# Thai and Lao, Myanmar, Khmer, kana, Chinese characters
for _lo, _hi in ((0xE01, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF),
                 (0x20000, 0x33FFF)):
    _KIND[_lo:_hi + 1] = WIDE


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Words of concatenated documents: (document, start, end, whether it begins a sentence) arrays."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    char = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    ink = np.flatnonzero(~(_KIND[char] & SPACE).astype(bool))
    if not len(ink):
        e = np.empty(0, np.int64)
        return e, e, e, e.astype(bool)
    kind = _KIND[char[ink]]
    doc = np.searchsorted(offsets, lead[ink], side="right") - 1
    place = np.arange(len(ink))
    # the last character that is no closing quote or bracket, if nothing stands between
    base = np.maximum.accumulate(np.where(kind & CLOSE, 0, place))
    whole = ink - ink[base] == place - base
    stop = whole & ((kind[base] & (STOP | FULL)) > 0) & (doc == doc[base])
    full = whole & ((kind[base] & FULL) > 0) & (doc == doc[base])
    feeds = np.concatenate(([0], np.cumsum(char == 10)))
    gap = ink[1:] - ink[:-1] > 1
    new_doc = doc[1:] != doc[:-1]
    cut = new_doc | (gap & (stop[:-1] | (feeds[ink[1:]] > feeds[ink[:-1]]))) \
        | (full[:-1] & ((kind[1:] & (CLOSE | STOP | FULL)) == 0))
    wide = (kind & WIDE) > 0
    mark = (kind & (MARK | FULL | CLOSE | STOP)) > 0
    word = gap | cut | wide[1:] | (wide[:-1] & ~mark[1:])
    first = np.concatenate(([0], np.flatnonzero(word) + 1))
    final = np.concatenate((first[1:] - 1, [len(ink) - 1]))
    after = np.concatenate((lead, [len(data)]))
    return doc[first], lead[ink[first]], after[ink[final] + 1], np.concatenate(([True], cut))[first]


def units(data: np.ndarray, offsets: np.ndarray, hasher: RollingHash):
    """Units of concatenated documents: (document, start, end of content, words, whether it begins a sentence) arrays.

    A unit is a sentence or a part of a long one; ``start`` is its first byte, the end excludes trailing white space.
    """
    doc, start, end, begins = words_of(data, offsets)
    if not len(doc):
        return doc, start, end, doc, begins
    sentence = np.cumsum(begins) - 1
    size = np.bincount(sentence)
    opens = begins.copy()
    long = np.flatnonzero(size[sentence] > PAIR_WORDS)
    if len(long):
        h = hasher.span(hasher.prefix(data), start[long], end[long])
        seen = np.lib.stride_tricks.sliding_window_view(h, NEAR)[:, ::-1]
        least = np.arange(NEAR - 1, len(h)) - seen.argmin(1)
        inside = sentence[long[:len(h) - NEAR + 1]] == sentence[long[NEAR - 1:]]
        after = long[least[inside]] + 1
        opens[after[after < len(opens)]] = True
    first = np.flatnonzero(opens)
    stop = np.concatenate((first[1:], [len(doc)]))
    return doc[first], start[first], end[stop - 1], stop - first, begins[first]


def _shortest(doc: np.ndarray, words: np.ndarray, size: int, least: int):
    """First and end of the shortest runs of at least ``size`` and ``least`` words, from every place in both directions."""
    n = len(doc)
    total = np.concatenate(([0], np.cumsum(words)))
    at = np.arange(n)
    ahead = np.maximum(at + size, np.searchsorted(total, total[:-1] + least))
    back = np.minimum(at + 1 - size, np.searchsorted(total, total[1:] - least, side="right") - 1)
    a, b = np.concatenate((at, back)), np.concatenate((ahead, at + 1))
    ok = (a >= 0) & (b <= n)
    a, b = a[ok], b[ok]
    ok = doc[a] == doc[b - 1]
    both = np.unique(a[ok] * (n + 1) + b[ok])
    return both // (n + 1), both % (n + 1)


def runs(doc: np.ndarray, words: np.ndarray, begins: np.ndarray):
    """First and end of all runs of units that are hashed."""
    n = len(doc)
    first = np.flatnonzero(begins)
    edge = np.concatenate((first, [n]))
    a, b = _shortest(doc[first], np.add.reduceat(words, first), RUN, MIN_WORDS)
    c, d = _shortest(doc, words, 1, PAIR_WORDS)
    # whole sentences of the second kind are covered by runs of the first when there are enough
    sentence = np.concatenate((np.cumsum(begins) - 1, [len(first)]))
    closed = np.concatenate((begins, [True]))
    more = ~(begins[c] & closed[d] & (sentence[d] - sentence[c] >= RUN))
    both = np.unique(np.concatenate((edge[a] * (n + 1) + edge[b], c[more] * (n + 1) + d[more])))
    return both // (n + 1), both % (n + 1)


def _over(hasher: RollingHash, values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of runs ``values[a:b]`` of unit hashes; white space between units does not count."""
    hasher._powers(len(values) + 1)
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(values * hasher._pow[:len(values)], dtype=U64)))
    return hasher.span(sums, a, b)


def _span_rows(batches):
    hashes = RollingHash(41), RollingHash(43)
    over = RollingHash(53), RollingHash(59)
    names = ["h1", "h2", "doc_id", "t", "pos", "size"]
    for batch in batches:
        whole = TextBatch(batch.column(1))
        for lo, hi in slices_by_bytes(whole.offsets, SLICE_BYTES):
            offsets = whole.offsets[lo:hi + 1] - whole.offsets[lo]
            data = whole.data[whole.offsets[lo]:whole.offsets[hi]]
            doc, start, end, words, begins = units(data, offsets, hashes[0])
            if not len(doc):
                continue
            a, b = runs(doc, words, begins)
            if not len(a):
                continue
            h1, h2 = (_over(o, h.span(h.prefix(data), start, end), a, b) for h, o in zip(hashes, over))
            d = doc[a]
            pos = a - np.searchsorted(doc, d)
            digests = TextBatch(batch.column(1).slice(lo, hi - lo)).digests()
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                 batch.column(0).slice(lo, hi - lo).take(pa.array(d)), pa.array(digests[d]),
                 pa.array(pos.astype(np.int32)), pa.array((b - a).astype(np.int32))], names)
        give_back()


def _cut(batches):
    names = ["doc_id", "text", "n_sentences", "n_removed", "n_spans"]
    hasher = RollingHash(41)
    for batch in batches:
        texts = TextBatch(batch.column(1))
        out, total, gone, spans_of = [], [], [], []
        for i, spans in enumerate(batch.column(2).to_pylist()):
            data = texts.document(i)
            ends = np.array([0, len(data)])
            if spans:
                _, start, _, _, begins = units(data, ends, hasher)
                a = np.array([s["pos"] for s in spans])
                mask = covered(len(start), a, a + np.array([s["size"] for s in spans]))
                bounds = np.concatenate((start, [len(data)]))
                keep = np.concatenate((np.ones(int(start[0]), bool), np.repeat(~mask, np.diff(bounds))))
                out.append(data[keep].tobytes().decode())
                gone.append(int(np.maximum.reduceat(mask, np.flatnonzero(begins)).sum()))
                spans_of.append(runs_of(mask))
            else:
                begins = words_of(data, ends)[3]
                out.append(data.tobytes().decode())
                gone.append(0)
                spans_of.append(0)
            total.append(int(begins.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
             pa.array(spans_of, pa.int64())], names)
        del texts, out
        give_back()


def removals(docs: DataFrame) -> DataFrame:
    """Spans to remove: ``doc_id, t, pos, size`` (unit numbers of each document).

    Half of the hash drops the runs found once before the others are compared.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(
        _span_rows, f"h1 long, h2 long, doc_id {kind}, t long, pos int, size int")
    again = rows.groupBy("h1").count().where(F.col("count") > 1).select("h1")
    likely = Scratch(docs.sparkSession).write(rows.join(again, "h1", "left_semi"), "likely")
    settle(docs.sparkSession)
    return later_places(likely, ["h1", "h2"])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, cleaned ``text``, n_sentences, n_removed, n_spans of every row.

    ``n_removed`` counts the sentences removed in whole or in part.
    """
    part = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    joined = with_spans(part, per_document(removals(part), "pos", "size"), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(
        _cut, f"doc_id {kind}, text string, n_sentences long, n_removed long, n_spans long"
    ).withColumnRenamed("doc_id", id_col)
