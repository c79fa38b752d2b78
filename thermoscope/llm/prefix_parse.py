"""Removal of repeated byte strings by a prefix-free parse of the corpus.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (smaller
document id, or earlier in the same document) is removed; matches never cross
documents.

Parse: a rolling hash over K bytes picks triggers, the positions whose hash is
the smallest (rightmost on ties) of some LENGTH - K + 1 neighbours.  So every
string of LENGTH bytes holds a trigger that its own bytes choose.  The phrase of
a trigger is all text that a string of LENGTH bytes around it can reach, cut at
the ends of the document.  Phrases overlap, so that no string falls between two.

Order of the corpus to a depth of LENGTH bytes, which is all that the question needs:

* Parse: occurrences of phrases meet on (trigger, phrase).  All but the first
  occurrence of a phrase are repeated as a whole.
* Dictionary, coarse: first occurrences of different phrases with one trigger
  share some of their strings.  The strings that chose the trigger are cut into
  cells of CELL neighbouring starts; cells meet on (core, block), the bytes that
  all strings of a cell share and the bytes that any of them has.  Again all but
  the first occurrence of a block are repeated as a whole.
* Dictionary, fine: what is left are cells with one core and different blocks, the
  few around the ends of each repeated passage.  A suffix array cut at LENGTH
  bytes, built by doubling over a task's slice of them, leaves the first place of
  each suffix class; the classes of all tasks then meet on a 128-bit key.

Only places and hashes are grouped, with pre-aggregated minima and joins that
Spark can split, so a phrase that stands in a third of all documents is no
single group.  Steps are written to the shared folder one by one.

Edge cases: null and empty texts and texts shorter than LENGTH bytes lose
nothing; a null id sorts before all others; rows that repeat an id and a text
are one document and give equal rows; extra columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, RollingHash, Scratch, mix64, settle, slices_by_bytes
from .repeats import TextBatch, covered, later_places, per_document, runs_of, with_spans

LENGTH = 100
K = 28
CELL = 15
SLICE_BYTES = 2 << 20
POSITION_BITS = 24


def owners(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Trigger of every string of LENGTH bytes by its start, -1 where a string would cross documents.

    ``hashes``: of every K bytes of the concatenated documents.
    """
    reach = LENGTH - K + 1
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.empty(0, np.int64)
    owner = np.empty(n, np.int64)
    mask = U64((1 << POSITION_BITS) - 1)
    for at in range(0, n, 1 << (POSITION_BITS - 1)):
        m = min(n - at, 1 << (POSITION_BITS - 1))
        part = hashes[at:at + m + reach - 1]
        # a hash with its position below it: the least value is the least hash, the rightmost on ties
        level, size = (part & ~mask) | (mask - np.arange(len(part), dtype=U64)), 1
        while size * 2 <= reach:
            level = np.minimum(level[:len(level) - size], level[size:])
            size *= 2
        least = np.minimum(level[:m], level[reach - size:reach - size + m])
        owner[at:at + m] = at + (mask - (least & mask)).astype(np.int64)
    inside = np.zeros(n, bool)
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if hi - lo >= LENGTH:
            inside[lo:hi - LENGTH + 1] = True
    owner[~inside] = -1
    return owner


def triggers(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, document) of the triggers of concatenated documents."""
    chosen = np.zeros(len(data) + 1, bool)
    chosen[owners(data, offsets, hashes)] = True   # -1 marks the extra place at the end
    pos = np.flatnonzero(chosen[:-1])
    return pos, np.searchsorted(offsets, pos, side="right") - 1


def phrases(data: np.ndarray, offsets: np.ndarray, hashers):
    """(document, trigger hash, phrase hash, trigger, end) of every phrase; places in ``data``."""
    h = hashers[0].windows(hashers[0].prefix(data), K)
    pos, doc = triggers(data, offsets, h)
    a = np.maximum(offsets[doc], pos + K - LENGTH)
    b = np.minimum(offsets[doc + 1], pos + LENGTH)
    ph = mix64(hashers[1].span(hashers[1].prefix(data), a, b) + (pos - a).astype(U64))
    return doc, h[pos], ph, pos, b


def _hashers():
    return RollingHash(61), RollingHash(67)


def _parts(batch):
    whole = TextBatch(batch.column(1))
    for lo, hi in slices_by_bytes(whole.offsets, SLICE_BYTES):
        base = whole.offsets[lo]
        yield lo, hi, whole.data[base:whole.offsets[hi]], whole.offsets[lo:hi + 1] - base


def _trigger_rows(batches):
    hashers = _hashers()
    for batch in batches:
        for lo, hi, data, offsets in _parts(batch):
            h = hashers[0].windows(hashers[0].prefix(data), K)
            pos, _ = triggers(data, offsets, h)
            yield pa.RecordBatch.from_arrays([pa.array(h[pos].view(np.int64))], ["trigger"])


def _phrase_rows(batches):
    hashers = _hashers()
    names = ["trigger", "phrase", "doc_id", "t", "pos", "stop"]
    for batch in batches:
        for lo, hi, data, offsets in _parts(batch):
            doc, th, ph, at, b = phrases(data, offsets, hashers)
            if not len(doc):
                continue
            column = batch.column(1).slice(lo, hi - lo)
            digests = TextBatch(column).digests()
            yield pa.RecordBatch.from_arrays(
                [pa.array(th.view(np.int64)), pa.array(ph.view(np.int64)),
                 batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(digests[doc]),
                 pa.array((at - offsets[doc]).astype(np.int32)), pa.array((b - offsets[doc]).astype(np.int32))], names)


def _cell_rows(batches):
    """Cells of the strings that contested triggers own: ``spans`` lists trigger positions."""
    hashers, others = _hashers(), (RollingHash(79), RollingHash(83))
    names = ["core", "block", "doc_id", "t", "pos", "stop"]
    for batch in batches:
        for lo, hi, data, offsets in _parts(batch):
            asked = np.zeros(len(data) + 1, bool)
            for i, spans in enumerate(batch.column(2).slice(lo, hi - lo).to_pylist()):
                asked[int(offsets[i]) + np.array([s["pos"] for s in spans])] = True
            owner = owners(data, offsets, hashers[0].windows(hashers[0].prefix(data), K))
            start = np.flatnonzero(asked[owner])   # -1 reads the extra place, which is false
            if not len(start):
                continue
            base = owner[start] - (LENGTH - K)
            cell = (start - base) // CELL
            new = np.ones(len(start), bool)
            new[1:] = (owner[start][1:] != owner[start][:-1]) | (cell[1:] != cell[:-1])
            trigger, cell, base = owner[start][new], cell[new], base[new]
            doc = np.searchsorted(offsets, trigger, side="right") - 1
            left = base + cell * CELL
            prefix = [h.prefix(data) for h in others]
            core = mix64(others[0].span(prefix[0], left + CELL - 1, left + LENGTH) + cell.astype(U64))
            a, b = np.maximum(left, offsets[doc]), np.minimum(left + CELL - 1 + LENGTH, offsets[doc + 1])
            block = mix64(others[1].span(prefix[1], a, b) + (a - left).astype(U64))
            ids, column = batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [pa.array(core.view(np.int64)), pa.array(block.view(np.int64)), ids.take(pa.array(doc)),
                 pa.array(TextBatch(column).digests()[doc]), pa.array((a - offsets[doc]).astype(np.int32)),
                 pa.array((b - offsets[doc]).astype(np.int32))], names)


def suffix_classes(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Rank of ``data[s:s+depth]`` for every start, in byte order: a suffix array cut at ``depth``, by doubling.

    Every start has ``depth`` bytes after it.
    """
    rank, size = data.astype(np.int64), 1
    while size * 2 <= depth:
        n = len(rank) - size
        _, rank = np.unique((rank[:n] << 32) | rank[size:size + n], return_inverse=True)
        size *= 2
    if size < depth:
        _, cls = np.unique((rank[starts] << 32) | rank[starts + depth - size], return_inverse=True)
        return cls
    return rank[starts]


def _suffix_rows(batches):
    """Strings of contested phrases: key and place of each local class's first, places of the others."""
    one, two = RollingHash(71), RollingHash(73)
    names = ["h1", "h2", "doc_id", "t", "pos", "later"]
    for batch in batches:
        for lo, hi, data, offsets in _parts(batch):
            pieces, docs, starts, at = [], [], [], 0
            for i, spans in enumerate(batch.column(2).slice(lo, hi - lo).to_pylist()):
                base, n = int(offsets[i]), int(offsets[i + 1] - offsets[i])
                mask = covered(n, [s["pos"] for s in spans], [s["stop"] for s in spans])
                edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                marks = np.zeros(n, bool)   # starts of strings inside some contested phrase
                marks[np.flatnonzero(covered(n, [s["pos"] for s in spans], [s["stop"] - LENGTH + 1 for s in spans]))] = True
                for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    s = np.flatnonzero(marks[x:y])
                    pieces.append(data[base + x:base + y])
                    starts.append((s + at, s + x))
                    docs.append(np.full(len(s), i))
                    at += y - x
            if not pieces:
                continue
            text = np.concatenate(pieces)
            where, pos = (np.concatenate(x) for x in zip(*starts))
            doc = np.concatenate(docs)
            ids, column = batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
            digests = TextBatch(column).digests()
            # place order inside the slice: id (null first), position, digest
            keys = [(v is not None, v if v is not None else 0) for v in ids.to_pylist()]
            rank_of = {v: r for r, v in enumerate(sorted(set(keys)))}
            order = np.lexsort((digests[doc], pos, np.array([rank_of[v] for v in keys])[doc]))
            cls = suffix_classes(text, where, LENGTH)[order]
            _, first = np.unique(cls, return_index=True)
            later = np.ones(len(cls), bool)
            later[first] = False
            # an equal place (a repeated row) is not later than the first one
            head = order[first][np.searchsorted(cls[first], cls)]
            same = (pos[order] == pos[head]) & (digests[doc[order]] == digests[doc[head]])
            if same.any():
                rk = np.array([rank_of[v] for v in keys])
                later &= ~(same & (rk[doc[order]] == rk[doc[head]]))
            w, d, p = where[order], doc[order], pos[order]
            h1 = one.span(one.prefix(text), w, w + LENGTH)
            h2 = two.span(two.prefix(text), w, w + LENGTH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), ids.take(pa.array(d)),
                 pa.array(digests[d]), pa.array(p.astype(np.int32)), pa.array(later)], names)


def _split(rows: DataFrame, scratch: Scratch, key: str, whole: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(all places of a whole but its first, first places of wholes that share their key with another)."""
    later = scratch.write(later_places(rows, [key, whole]).select("doc_id", "t", "pos", "stop"), f"{name}-later")
    settle(rows.sparkSession)
    firsts = rows.groupBy(key, whole).agg(F.min(F.struct("doc_id", "pos", "t", "stop")).alias("p"))
    several = rows.groupBy(key).agg(F.min(whole).alias("lo"), F.max(whole).alias("hi")).where("lo <> hi").select(key)
    contested = scratch.write(firsts.join(several, key, "left_semi").select("p.*"), f"{name}-contested")
    settle(rows.sparkSession)
    return later, contested


def removals(docs: DataFrame) -> DataFrame:
    """Byte ranges to remove: ``doc_id, t, pos, stop``."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    part = docs.select("doc_id", "text")
    place = f"doc_id {kind}, t long, pos int, stop int"
    again = scratch.write(part.mapInArrow(_trigger_rows, "trigger long").groupBy("trigger")
                          .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("trigger"), "triggers")
    settle(spark)
    rows = part.mapInArrow(_phrase_rows, f"trigger long, phrase long, {place}")
    rows = scratch.write(rows.join(again, "trigger", "left_semi"), "phrases")
    scratch.drop("triggers")
    settle(spark)
    # a phrase is known by its trigger's position; its start follows
    later, contested = _split(rows, scratch, "trigger", "phrase", "phrase")
    phrases_out = later.withColumn("pos", F.greatest(F.col("pos") + (K - LENGTH), F.lit(0)))
    scratch.drop("phrases")

    asked = with_spans(part, per_document(contested, "pos"), "inner").select("doc_id", "text", "spans")
    cells = scratch.write(asked.mapInArrow(_cell_rows, f"core long, block long, {place}"), "cells")
    scratch.drop("phrase-contested")
    settle(spark)
    cells_out, contested = _split(cells, scratch, "core", "block", "cell")
    scratch.drop("cells")

    asked = with_spans(part, per_document(contested, "pos", "stop"), "inner").select("doc_id", "text", "spans")
    suffixes = scratch.write(asked.mapInArrow(
        _suffix_rows, f"h1 long, h2 long, doc_id {kind}, t long, pos int, later boolean"), "suffixes")
    scratch.drop("cell-contested")
    settle(spark)
    known = suffixes.where("later").select("doc_id", "t", "pos")
    found = later_places(suffixes.where("NOT later").drop("later"), ["h1", "h2"]).select("doc_id", "t", "pos")
    strings = known.union(found).withColumn("stop", F.col("pos") + LENGTH)
    whole = phrases_out.union(cells_out).where(F.col("stop") - F.col("pos") >= LENGTH)
    out = scratch.write(whole.union(strings), "removals")
    for name in ("suffixes", "phrase-later", "cell-later"):
        scratch.drop(name)
    settle(spark)
    return out


def _cut(batches):
    names = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        texts = TextBatch(batch.column(1))
        kept, size, gone, runs, sha = [], [], [], [], []
        for i, spans in enumerate(batch.column(2).to_pylist()):
            data = texts.document(i)
            n = r = 0
            if spans:
                mask = covered(len(data), [s["pos"] for s in spans], [s["stop"] for s in spans])
                n, r = int(mask.sum()), runs_of(mask)
                rest = data[~mask].tobytes()
            else:
                rest = data.tobytes()
            kept.append(rest)
            size.append(len(data))
            gone.append(n)
            runs.append(r)
            sha.append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
             pa.array(runs, pa.int64()), pa.array(sha, pa.string())], names)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, kept`` (remaining bytes), n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    part = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    joined = with_spans(part, per_document(removals(part), "pos", "stop"), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(
        _cut, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    ).withColumnRenamed("doc_id", id_col)
