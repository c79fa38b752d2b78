"""Token ids in binary shard files with Simple-8b word-aligned coding.

File format
-----------
A shard file is a sequence of blocks, each followed by one byte 0x0A.  Every
block holds whole documents in ascending id order.  All integers are little
endian::

    magic    4 bytes  b"S8W1"
    n_docs   u32      documents in the block
    n_ids    u64      ids in the block
    n_words  u64      64-bit words of payload
    n_parts  u32      coding parts; a part holds PART ids, the last one the rest
    doc_ids  i64 * n_docs
    lengths  u64 * n_docs   ids of each document, its end id included
    offsets  u64 * n_parts  first payload word of each part
    payload  u64 * n_words

A payload word keeps its selector in the top four bits.  Selectors 1..14 say
how many ids share the low 60 bits and how wide each is.  Selector 0 is an
escape: the next word holds one raw 64-bit id.  A part starts on a word of its
own, so parts decode independently, and a decoder expands all words of one
selector together.

Edge cases: a null or empty text holds the end id alone; a null ``doc_id``
cannot be ordered or read back and raises; repeated ids keep all their rows in
unspecified relative order; an empty table gives no blocks and an empty result.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, slices_by_bytes, take_ragged

MAGIC = b"S8W1"
HEAD = struct.Struct("<4sIQQI")
PART = 4096              # ids of a coding part
BLOCK_IDS = 1 << 17      # a block is closed by the document that reaches this
SHARD_BYTES = 24 << 20   # text bytes of a shard
SLICE_BYTES = 6 << 20   # text bytes tokenised together
CACHE_WORDS = 350_000    # words a worker remembers

# Fixed values of the coding: (ids in a word, bits of an id) by selector 1..14.
LAYOUTS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8),
           (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNT = np.array([1] + [c for c, _ in LAYOUTS] + [0], np.int64)

RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _choose(width: np.ndarray) -> np.ndarray:
    """Best selector at every position (``width``: bits of each id).

    Positions past the end count as zeros, so a last word may be part filled.
    """
    n = len(width)
    best = np.zeros(n, np.uint8)
    best[width <= 60] = 14
    pad = np.zeros(n + 64, np.uint8)
    pad[:n] = width
    least = int(width.min()) if n > 64 else 0
    level, size = pad, 1  # widest id in [i, i + size): doubled windows, one overlap per count
    for sel in range(13, 0, -1):
        count, bits = LAYOUTS[sel - 1]
        if bits < least:
            break
        while size * 2 <= count:
            level = np.maximum(level[:len(level) - size], level[size:])
            size *= 2
        top = np.maximum(level[:n], level[count - size:count - size + n])
        np.putmask(best, top <= bits, sel)
    return best


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code ids (uint64) into words; returns (words, first word of every part)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    # bits of an id: the exponent of its float value, mended where rounding went up a power of two
    width = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    high = width > 52
    if high.any():
        width[high] = [int(x).bit_length() for x in ids[high]]
    best = _choose(width)
    hop = _COUNT[best].tolist()
    starts, firsts, i = [], [], 0
    for end in range(PART, n + PART, PART):
        end = min(end, n)
        firsts.append(len(starts))
        while i < end:
            starts.append(i)
            i += hop[i]
        i = end
    starts = np.array(starts, np.int64)
    sel = best[starts]
    place = np.arange(len(starts))
    escapes = sel == 0
    if escapes.any():
        place[1:] += np.cumsum(escapes[:-1])
    out = np.zeros(len(starts) + int(escapes.sum()), np.uint64)
    room = np.minimum(n, (starts // PART + 1) * PART) - starts  # ids left in the word's part
    padded = np.concatenate((ids, np.zeros(64, np.uint64)))
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        if s == 0:
            out[place[rows] + 1] = ids[starts[rows]]
            continue
        count, bits = LAYOUTS[s - 1]
        word = np.full(len(rows), int(s) << 60, np.uint64)
        at, left = starts[rows], room[rows]
        part_end = np.flatnonzero(left < count)
        for k in range(count):
            value = padded[at + k]
            if len(part_end):
                value[part_end[left[part_end] <= k]] = 0
            word |= value << np.uint64(k * bits)
        out[place[rows]] = word
    return out, place[firsts].astype(np.uint64)


def unpack(words: np.ndarray, offsets: np.ndarray, n_ids: int) -> np.ndarray:
    """Invert :func:`pack`: all words of one selector are expanded together."""
    if n_ids == 0:
        return np.empty(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    if (sel == 0).any() or (sel == 15).any():
        raw = np.zeros(len(words), bool)  # a raw word follows an escape that is not itself raw
        for i in np.flatnonzero(sel == 0):
            if not raw[i]:
                raw[i + 1] = True
        sel[raw] = 15
    counts = _COUNT[sel]
    bounds = np.concatenate((offsets.astype(np.int64), [len(words)]))
    before = np.concatenate(([0], np.cumsum(counts)))
    part = np.repeat(np.arange(len(offsets)), np.diff(bounds))
    pos = before[:-1] - before[bounds[:-1]][part] + part * PART
    out = np.zeros(n_ids + 64, np.uint64)
    limit = np.minimum((part + 1) * PART, n_ids)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        if s == 15:
            continue
        if s == 0:
            out[pos[rows]] = words[rows + 1]
            continue
        count, bits = LAYOUTS[s - 1]
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            keep = rows[pos[rows] + k < limit[rows]]
            out[pos[keep] + k] = (words[keep] >> np.uint64(k * bits)) & mask
    return out[:n_ids]


def write_block(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = pack(ids)
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), len(words), len(offsets))
    return b"".join((head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(),
                     offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()))


def read_blocks(data: bytes):
    """Yield (doc_ids, lengths, ids) of every block of a shard file."""
    at = 0
    while at < len(data):
        magic, n_docs, n_ids, n_words, n_parts = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"not a token block at byte {at}")
        at += HEAD.size
        doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        lengths = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
        at += 16 * n_docs
        offsets = np.frombuffer(data, "<u8", n_parts, at)
        at += 8 * n_parts
        words = np.frombuffer(data, "<u8", n_words, at)
        at += 8 * n_words + 1
        yield doc_ids, lengths, unpack(words, offsets, n_ids)


_BEFORE_MARK = r"([a-z])([!-&(-/:-@\[-`{-~])"  # a letter, then ASCII punctuation but no apostrophe
_UNSAFE = "<\\||[\u0300-\u036f]"  # strings of special tokens; marks that could combine


class WordEncoder:
    """Ids of whole texts through a word cache of the tokenizer library.

    The tokenizer lower-cases, and its split pattern never crosses a blank, a
    line feed or a change from letters to punctuation (apostrophes aside).  So
    the ids of a text are the ids of such pieces in order, and each distinct
    piece goes to the library once per worker: letter-only pieces straight to
    its BPE model, all others through the whole tokenizer.
    """

    def __init__(self, model: bytes):
        import re

        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_buffer(model)
        self.plain = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
        # byte-level alphabet of the two UTF-8 bytes of Latin-1 letters: C3 keeps its place,
        # the second byte too from A1 on; 80..A0 follow U+0100 + 33 in order, AD is the last
        second = lambda b: chr(b) if b >= 0xA1 and b != 0xAD else chr(0x143) if b == 0xAD else chr(0x100 + 33 + b - 0x7F)
        self.bytes = {c: "\u00c3" + second(c - 0x40) for c in range(0xDF, 0x100)}
        probe = "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
        for c in probe:  # the short way must agree with the library
            if [t.id for t in self.tokenizer.model.tokenize(c.translate(self.bytes))] != \
                    self.tokenizer.encode(c, add_special_tokens=False).ids:
                self.plain = re.compile("[a-z]+").fullmatch
        self._reset()

    def _reset(self) -> None:
        self.slot = {"": 0}
        self.starts, self.lens = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _learn(self, words: list[str]) -> None:
        model, plain, table = self.tokenizer.model.tokenize, self.plain, self.bytes
        got = [[t.id for t in model(w if w.isascii() else w.translate(table))] if plain(w) else None for w in words]
        rest = [i for i, x in enumerate(got) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            got[i] = e.ids
        lens = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(lens.sum()))
        at = len(self.ids) + np.cumsum(lens) - lens
        self.slot.update(zip(words, range(len(self.lens), len(self.lens) + len(words))))
        self.starts, self.lens = np.concatenate((self.starts, at)), np.concatenate((self.lens, lens))
        self.ids = np.concatenate((self.ids, flat))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text, all ids) of a string array; null counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _UNSAFE)
        low = pc.replace_substring_regex(pc.ascii_lower(texts), _BEFORE_MARK, r"\1 \2")
        if pc.any(odd).as_py():
            low = pc.if_else(odd, texts, low)
        words = pc.split_pattern(pc.replace_substring(low, "\n", " "), " ")
        per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.slot) + len(names) > CACHE_WORDS:
            self._reset()
        known = self.slot
        new = [w for w in names if w not in known]
        if new:
            self._learn(new)
        slot = np.fromiter(map(self.slot.__getitem__, names), np.int64, len(names))
        rows = slot[coded.indices.to_numpy()]
        lens = self.lens[rows]
        bounds = np.concatenate(([0], np.cumsum(per_text)))
        sums = np.concatenate(([0], np.cumsum(lens)))
        return sums[bounds[1:]] - sums[bounds[:-1]], take_ragged(self.ids, self.starts[rows], lens)


_ENCODERS: dict[int, WordEncoder] = {}


def _encoder(model: bytes) -> WordEncoder:
    key = zlib.crc32(model)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(model)
    return _ENCODERS[key]


def _encode_blocks(model_b, end_id: int):
    def run(batches):
        enc = _encoder(model_b.value)
        docs, lens, ids, held = [], [], [], 0

        def close():
            data = write_block(np.concatenate(docs), np.concatenate(lens), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["block"])

        for batch in batches:
            text = batch.column(1).cast(pa.large_string())
            filled = pc.fill_null(text, "")
            offsets = np.concatenate(([0], np.cumsum(pc.binary_length(filled).to_numpy())))
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in slices_by_bytes(offsets, SLICE_BYTES):
                n, flat = enc.encode(filled.slice(lo, hi - lo))
                ends = np.cumsum(n)
                docs.append(keys[lo:hi].astype(np.int64))
                lens.append(n + 1)
                ids.append(np.insert(flat.astype(np.uint64), ends, end_id))
                held += len(ids[-1])
                if held >= BLOCK_IDS:
                    yield close()
                    docs, lens, ids, held = [], [], [], 0
        if docs:
            yield close()
    return run


def write_shards(docs: DataFrame, path: str, model: bytes, end_id: int = 2,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise whole texts and write shard files in ascending id order.

    Rows are range-partitioned by id, so a shard holds one id range; each task
    streams its rows through the tokenizer and Spark's committing writer puts
    the block bytes into files, so a repeated or lost task leaves no half shard.
    """
    spark = docs.sparkSession
    part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = part.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"),
                    F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    if size["nulls"]:
        raise ValueError(f"{size['nulls']} documents have no id")
    shards = max(1, -(-int(size["b"]) // SHARD_BYTES))
    model_b = spark.sparkContext.broadcast(model)
    blocks = (part.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
              .mapInArrow(_encode_blocks(model_b, end_id), "block binary"))
    # the text writer puts the bytes of a value and a line feed into the file, unchanged
    blocks.select(F.col("block").cast("string").alias("value")).write.mode("overwrite").text(path)


def _decode_shards(batches):
    names = ["shard", "first_id", "doc_id", "offset", "n_tokens", "ids_crc32"]
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            at, first = 0, None
            for doc_ids, lens, ids in read_blocks(data.as_buffer()):
                first = int(doc_ids[0]) if first is None else first
                ends = np.cumsum(lens)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lens.tolist())]
                k = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * k, pa.string()), pa.array(np.full(k, first, np.int64)), pa.array(doc_ids),
                     pa.array(at + ends - lens), pa.array(lens), pa.array(crc, pa.int64())], names)
                at += int(ends[-1])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Decode shard files: doc_id, start, n_tokens, ids_crc32 of every document.

    ``start`` counts the ids of all documents before it: the place in its file
    plus the ids of all earlier files, from one total per file.
    """
    scratch = Scratch(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    rows = scratch.write(files.mapInArrow(
        _decode_shards, "shard string, first_id long, doc_id long, offset long, n_tokens long, ids_crc32 long"), "ids")
    totals = rows.groupBy("shard", "first_id").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("first_id", "shard").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return rows.join(before, "shard").select(
        "doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, model: bytes, end_id: int = 2) -> DataFrame:
    """Write the shards of ``docs`` below the shared folder and read them back."""
    spark = docs.sparkSession
    path = Scratch(spark).path("shards")
    write_shards(docs, path, model, end_id)
    return read_shards(spark, path)
