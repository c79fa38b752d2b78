"""SentencePiece BPE encoding by a prefix table, and decoding.

Merge BPE has one property that makes it a table problem: the encoding of a
string is the only piece sequence whose neighbouring pieces are *compatible*
(merging the joined text of two neighbours gives back the two pieces).  So every
prefix of a string has a unique last piece.  The table of last pieces is filled
left to right: an Aho-Corasick automaton lists the pieces that end at each
position, and the one that is compatible with the last piece of the prefix
before it is stored.  The ids are then read backwards from the end.

Texts are cut before every run of meta spaces, which no piece crosses, and each
distinct segment is encoded once per worker.  A segment with two or more meta
spaces is merged directly, since pieces made of meta spaces only tie in score.
Characters without a piece become their UTF-8 byte pieces.

Edge cases: a null or empty text has the end id alone and decodes to the empty
text; extra columns are not read; repeated rows give repeated results; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices_by_bytes, take_ragged

SPACE = "▁"
CACHE_SEGMENTS = 250_000
CACHE_PAIRS = 500_000
SLICE_BYTES = 3 << 20


class PieceModel:
    """Pieces, scores and byte fallback of a SentencePiece BPE model."""

    def __init__(self, proto: bytes):
        import ahocorasick
        import sentencepiece
        sp = self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.end_id = sp.eos_id()
        self.bytes_at = sp.piece_to_id("<0x00>")
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id_of = {sp.id_to_piece(i): i for i in plain}
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        if any(SPACE in p[1:] and p.strip(SPACE) for p in self.id_of):
            raise ValueError("a piece crosses a word boundary; segments cannot be encoded apart")
        # the normaliser changes nothing in most models of this kind; if it does, texts go through it
        probe = "Aﬁ x  \t\n　Å\u0000 "
        plain_space = sp.normalize("a")[:-1]
        if plain_space not in ("", SPACE) or sp.normalize(probe) != (plain_space + probe).replace(" ", SPACE):
            raise ValueError("only models whose normaliser keeps the text as it is")
        self.prefix = plain_space
        self.line_feed_alone = not any("\n" in p for p in self.id_of)
        self.pattern = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+" if self.line_feed_alone
                                  else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        # punctuation that no piece joins to an ASCII letter before it: nothing merges there either
        joined = {c for p in self.id_of for c in re.findall("(?<=[A-Za-z])[^A-Za-z]", p)}
        free = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in joined)
        self.apart = "([A-Za-z])([" + re.escape(free) + "])" if free else None
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if self.merge(p) == [p]:  # a piece that its own text never merges to cannot occur
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.segments: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.segments = {"": 0}
        self.starts, self.lens = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.empty(0, np.int32)

    def merge(self, text: str) -> list[str]:
        """Merge BPE by definition: best score first, leftmost on ties."""
        score = self.score
        if len(text) < 24:
            parts = list(text)
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    s = score.get(parts[i] + parts[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if at < 0:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            return parts
        parts: list = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        queue = []

        def offer(i):
            j = after[i]
            if j < len(parts):
                s = score.get(parts[i] + parts[j])
                if s is not None:
                    heapq.heappush(queue, (-s, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def compatible(self, a: int, b: int) -> bool:
        left, right = self.text[a], self.text[b]
        return self.merge(left + right) == [left, right]

    def encode_segment(self, seg: str) -> list[int]:
        """Ids of one segment from its table of last pieces."""
        if seg.startswith(SPACE * 2):
            out = []
            for p in self.merge(seg):
                i = self.id_of.get(p)
                out.extend((i,) if i is not None else [self.bytes_at + b for b in p.encode()])
            return out
        n, pairs = len(seg), self.pairs
        last = [-1] * (n + 1)   # piece that ends the encoding of seg[:i]; -1: none
        back = [0] * (n + 1)    # where that piece starts
        for end, (size, piece) in self.automaton.iter(seg):
            end += 1
            if last[end] >= 0:
                continue
            at = end - size
            if at and last[at] >= 0:  # nothing merges across a character without a piece
                key = last[at] << 20 | piece
                ok = pairs.get(key)
                if ok is None:
                    ok = pairs[key] = self.compatible(last[at], piece)
                if not ok:
                    continue
            last[end], back[end] = piece, at
        out, i = [], n
        while i:
            if last[i] >= 0:
                out.append(last[i])
                i = back[i]
            else:
                out.extend(self.bytes_at + b for b in reversed(seg[i - 1].encode()))
                i -= 1
        out.reverse()
        return out

    def _learn(self, segs: list[str]) -> None:
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        got = [self.encode_segment(x) for x in segs]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for x in got for i in x), np.int32, int(lens.sum()))
        at = len(self.ids) + np.cumsum(lens) - lens
        self.segments.update(zip(segs, range(len(self.lens), len(self.lens) + len(segs))))
        self.starts, self.lens = np.concatenate((self.starts, at)), np.concatenate((self.lens, lens))
        self.ids = np.concatenate((self.ids, flat))

    def _slots(self, segs: list[str]) -> np.ndarray:
        if len(self.segments) + len(segs) > CACHE_SEGMENTS:
            self._reset()
        known = self.segments
        new = [x for x in dict.fromkeys(segs) if x not in known]
        if new:
            self._learn(new)
        return np.fromiter(map(self.segments.__getitem__, segs), np.int64, len(segs))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids in order); null counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, "^ |  |" + SPACE + "|\x01").to_numpy(zero_copy_only=False)
        rows_of, counts = [], np.zeros(len(texts), np.int64)
        usual = np.flatnonzero(~odd)
        if len(usual):
            part = texts.take(pa.array(usual)) if odd.any() else texts
            marked = pc.replace_substring(part, " ", "\x01" + SPACE)
            if self.line_feed_alone:
                marked = pc.replace_substring(marked, "\n", "\x01\n\x01")
            if self.apart:
                marked = pc.replace_substring_regex(marked, self.apart, "\\1\x01\\2")
            if self.prefix:
                marked = pc.if_else(pc.equal(part, ""), marked, pc.binary_join_element_wise(
                    pa.scalar(self.prefix, marked.type), marked, pa.scalar("", marked.type)))
            segs = pc.split_pattern(marked, "\x01")
            counts[usual] = pc.list_value_length(segs).to_numpy(zero_copy_only=False)
            coded = segs.flatten().dictionary_encode()
            names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            starts, lens = self._rows(names, coded.indices.to_numpy())
            rows_of.append((usual, starts, lens, self.ids))
        if odd.any():
            rare = np.flatnonzero(odd)
            segs = []
            for i in rare.tolist():
                found = self.pattern.findall(self.prefix + texts[i].as_py().replace(" ", SPACE))
                counts[i] = len(found)
                segs.extend(found)
            starts, lens = self._rows(segs, np.arange(len(segs)))
            rows_of.append((rare, starts, lens, self.ids))
        n_ids, pieces = np.zeros(len(texts), np.int64), []
        for rows, starts, lens, ids in rows_of:
            ends = np.cumsum(counts[rows])
            sums = np.concatenate(([0], np.cumsum(lens)))
            n_ids[rows] = sums[ends] - sums[ends - counts[rows]]
            pieces.append(take_ragged(ids, starts, lens))
        if len(pieces) < 2:
            return n_ids, pieces[0] if pieces else np.empty(0, np.int32)
        flat, place = np.concatenate(pieces), np.zeros(len(texts), np.int64)
        at = 0
        for rows, *_ in rows_of:
            place[rows] = at + np.cumsum(n_ids[rows]) - n_ids[rows]
            at += int(n_ids[rows].sum())
        return n_ids, take_ragged(flat, place, n_ids)

    def _rows(self, names: list[str], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self._slots(names)[index] if len(names) else np.empty(0, np.int64)
        return self.starts[slot], self.lens[slot]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.sp.decode(ids, num_threads=1) if ids else []


_MODELS: dict[int, PieceModel] = {}


def piece_model(proto: bytes) -> PieceModel:
    key = zlib.crc32(proto)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = PieceModel(proto)
    return _MODELS[key]


def _lists(flat: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """The ids of each text as a list, all numbers turned into Python's at once (one by one takes longer than to decode them)."""
    ids, at = flat.tolist(), bounds.tolist()
    return [ids[lo:hi] for lo, hi in zip(at, at[1:])]


def encode_texts(docs: DataFrame, proto: bytes, id_col: str = "doc_id", text_col: str = "text",
                 end_id: bool = True, decode: bool = True) -> DataFrame:
    """Ids (and the text decoded from them) of every row: ``id_col, ids array<int>, decoded string``.

    A map without a shuffle; a task holds one Arrow batch and its word cache.
    """
    spark = docs.sparkSession
    proto_b = spark.sparkContext.broadcast(proto)
    key_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = piece_model(proto_b.value)
        for batch in batches:
            text = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            offsets = np.concatenate(([0], np.cumsum(pc.binary_length(text).to_numpy())))
            for lo, hi in slices_by_bytes(offsets, SLICE_BYTES):
                n, flat = model.encode(text.slice(lo, hi - lo))
                if end_id:
                    flat = np.insert(flat, np.cumsum(n), model.end_id)
                    n = n + 1
                bounds = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.astype(np.int32)))
                texts = model.decode(_lists(flat, bounds)) if decode else [None] * (hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), ids, pa.array(texts, pa.string())],
                    [id_col, "ids", "decoded"])
            give_back()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key_type}, ids array<int>, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens and SHA-256 digests of the ids and the decoded text, by SQL functions."""
    return encoded.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
