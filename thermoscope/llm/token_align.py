"""Links between the tokens of two tokenizers over the same bytes, with corpus counts.

Tokenizer A (byte-level BPE) encodes a blank and the text, tokenizer B (merge-type
SentencePiece, which puts a blank in front) the text.  Byte offsets at which
tokens of both end cut a text into groups; every A token links with every B token of its group.

* **Identity map.**  An array of the size of A's vocabulary gives the B id with the
  same bytes.  Exact one-to-one groups are such pairs; so are equal tokens inside larger
  groups.  How many documents hold an identity pair is counted in a vector of the length of A's vocabulary
  in every task; the vectors are added up in a tree.
* **Pair shuffle.**  Only the other pairs, from irregular groups, are shuffled: their
  counts are added within a block of documents first.
* Neither tokenizer has a token across a blank that stands between two other characters, nor across a
  single line feed between two, so texts are cut there into units; a unit is encoded and aligned
  once per worker.  A document is a list of units, and a block stores documents, units and pair
  numbers in compact arrays, so texts are read and encoded once.  The arrays travel as one compressed value: as array columns
  a block's million numbers took Spark's Parquet reader several times their size.  A stored file holds a few
  blocks, since the reader takes up a file's rows together.
* **Scores.**  Each block asks for the counts of its irregular pairs by a join on the pair and
  meets the answers by its number; the identity counts and the highest
  count of every A id are broadcast, two vectors of the length of A's vocabulary.

Edge cases: a null or empty text, or one whose joined tokens do not give back its
bytes in A or B, has no tokens: zeros and an empty digest.  A null id is kept, repeated rows count as
documents of their own; extra columns are not read; an empty table gives an
empty result.  A block is at most BLOCK_BYTES of text or one text; a text is cut in pieces of
CHUNK_CHARS, and a task holds the arrays of one block.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, settle, short_batches, slices_by_bytes, take_ragged
from .words import text_column

BLOCK_BYTES = 2 << 20
CHUNK_CHARS = 1 << 20
CACHE_UNITS = 150_000   # units from which a worker sheds some
KEPT_UNITS = 70_000     # the most used ones that it keeps then
HELD_LINKS = 1_000_000
JOINED = 2000
BATCH_ROWS = 2000       # rows that a worker gets at a time
FILE_BLOCKS = 16        # blocks in a stored file, at most
# fixed value: the split of byte-level vocabularies into words
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FAN_IN = 16
META = "▁"
# cuts before a single blank and around a single line feed between other characters
_CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
_TWO_BLANKS = re.compile(r"\s\s")
_DIGITS = 10   # of a token id, at most


def _byte_alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def pieces_of(text: str):
    """A text in pieces of about CHUNK_CHARS characters that end at unit boundaries.

    The characters around a cut are those of a unit boundary, so a piece splits as within the whole text.
    """
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + CHUNK_CHARS) if len(text) - at > CHUNK_CHARS else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def _bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


class _Slots(dict):
    """Numbers of units; a unit asked for the first time gets the next one and is noted as new."""

    def __init__(self, owner: "Aligner", new: list[tuple[int, str]]):
        super().__init__()
        self.owner, self.new = owner, new

    def __missing__(self, unit: str) -> int:
        n = self.owner.known
        self.owner.known = n + 1
        self[unit] = n
        self.new.append((n, unit))
        return n


class Aligner:
    """The two tokenizers, the identity map and the units aligned so far.

    ``words`` are units of a blank and characters without blanks at either end; ``others`` are the rest.
    """

    def __init__(self, a_json: bytes, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_buffer(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        alphabet = _byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.merger = self._merger(json.loads(a_json), alphabet)
        b = self.b
        self.b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else
                        b.id_to_piece(i).replace(META, " ").encode() for i in range(b.get_piece_size())]
        self.n_b = len(self.b_bytes)
        pieces = [b.id_to_piece(i) for i in range(self.n_b) if not (b.is_byte(i) or b.is_control(i) or b.is_unknown(i))]
        if any((META in p[1:] and p.strip(META)) or "\n" in p for p in pieces):
            raise ValueError("a piece crosses a blank or a line feed; units cannot be encoded apart")
        probe = "Aﬁ x  \t\n　Å\u0000 "
        if b.normalize(probe) != (META + probe).replace(" ", META) or len(b.encode("\n")) != 2:
            raise ValueError("only models that put a blank in front and keep the text as it is")
        by_bytes = {}
        for i in sorted(range(self.n_b), key=lambda i: (b.is_byte(i), i), reverse=True):
            if not (b.is_control(i) or b.is_unknown(i)):
                by_bytes[self.b_bytes[i]] = i   # a plain piece before a byte piece, the smallest id first
        #: B id with the bytes of each A id, or -1
        self.same = np.array([by_bytes.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        shown = [str(i).encode() for i in range(max(len(self.a_bytes), self.n_b))]
        self.digits = np.frombuffer(b"".join(x.ljust(_DIGITS) for x in shown), np.uint8)
        self.n_digits = np.array([len(x) for x in shown], np.int64)
        self.forget()

    def _merger(self, spec: dict, alphabet: dict[str, int]):
        """A faster merger with the same results, if the file's merges stand in the order of the ids they make.

        Then the pair of the earliest merge is the pair whose joined bytes have the smallest id.
        """
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        joined = ["".join(x if isinstance(x, list) else x.split(" ")) for x in model["merges"]]
        ids = [model["vocab"][x] for x in joined]
        if (spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
                or model.get("ignore_merges") or any(x >= y for x, y in zip(ids, ids[1:]))):
            return None
        import tiktoken
        ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        for t in spec.get("added_tokens", ()):
            ranks.pop(t["content"].encode(), None)
        return tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def forget(self) -> None:
        self.known, self.learnt = 0, 0
        self.new_words: list[tuple[int, str]] = []
        self.new_others: list[tuple[int, str]] = []
        self.words, self.others = _Slots(self, self.new_words), _Slots(self, self.new_others)
        self.names: list[bytes] = []                 # groups of a unit as text, each followed by a semicolon
        self.good = np.empty(0, bool)                # whether both tokenizers give back the unit's bytes
        self.sizes = np.empty((0, 4), np.int64)      # tokens of A, tokens of B, groups, links
        self.links = np.empty(0, np.int64)           # A id * n_b + B id of every link, unit by unit
        self.starts = np.empty(0, np.int64)
        self.uses = np.empty(0, np.int64)            # how often each unit was met, halved whenever units are shed

    def shed(self) -> None:
        """Keep the KEPT_UNITS units met most often: most units of a text are rare, and the usual ones are not learnt again."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[:KEPT_UNITS])
        number = np.full(self.known, -1)
        number[keep] = np.arange(len(keep))
        for slots in (self.words, self.others):
            left = [(u, k) for u, k in zip(slots, number[list(slots.values())].tolist()) if k >= 0] if slots else []
            slots.clear()
            slots.update(left)
        self.names = list(map(self.names.__getitem__, keep.tolist()))
        self.good, self.uses = self.good[keep], self.uses[keep] // 2
        self.links = take_ragged(self.links, self.starts[keep], self.sizes[keep, 3])
        self.sizes = self.sizes[keep]
        self.starts = _bounds(self.sizes[:, 3])[:-1]
        self.known = self.learnt = len(keep)

    def _encode_a(self, words: list[str], others: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, tokens of each); words are encoded some thousand at a time, ``raw`` are their bytes."""
        if self.merger:
            one = self.merger.encode_ordinary
            joined = partial(self.merger.encode_to_numpy, disallowed_special=())
        else:
            def one(text):
                return self.a.encode(text, add_special_tokens=False).ids
            joined = one
        parts = [joined(" " + " ".join(words[k:k + JOINED])) for k in range(0, len(words), JOINED)]
        flat = np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int64)
        # a word's tokens are those up to its last byte
        sizes = np.fromiter(map(len, raw), np.int64, len(words))
        ends = np.searchsorted(np.cumsum(self.a_len[flat]), np.cumsum(sizes)) + 1
        rest = [one(u) for u in others]
        return (np.concatenate((flat, np.fromiter(chain.from_iterable(rest), np.int64))),
                np.concatenate((np.diff(ends, prepend=0), np.fromiter(map(len, rest), np.int64, len(rest)))))

    def _encode_b(self, words: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # the library puts a blank in front; a unit without one follows a line feed instead
        got = self.b.encode(words, num_threads=1) if words else []
        rest = self.b.encode([u[1:] if u[0] == " " else "\n" + u for u in others], num_threads=1) if others else []
        got = got + [ids if u[0] == " " else ids[2:] for u, ids in zip(others, rest)]
        return np.fromiter(chain.from_iterable(got), np.int64), np.fromiter(map(len, got), np.int64, len(got))

    def _gives_back(self, flat: np.ndarray, counts: np.ndarray, table: list[bytes], table_lens: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether the tokens of each unit give back its bytes."""
        if b"".join(map(table.__getitem__, flat.tolist())) == b"".join(raw):
            total = np.concatenate(([0], np.cumsum(table_lens[flat])))[_bounds(counts)]
            if np.array_equal(np.diff(total), np.fromiter(map(len, raw), np.int64, len(raw))):
                return np.ones(len(raw), bool)
        at = _bounds(counts).tolist()
        ids = flat.tolist()
        return np.array([b"".join(map(table.__getitem__, ids[at[i]:at[i + 1]])) == r for i, r in enumerate(raw)], bool)

    def learn(self) -> None:
        """Encode and align the units noted as new."""
        if not (self.new_words or self.new_others):
            return
        number = np.array([n for n, _ in self.new_words] + [n for n, _ in self.new_others]) - self.learnt
        words, others = [w for _, w in self.new_words], [u for _, u in self.new_others]
        self.new_words.clear()
        self.new_others.clear()
        raw = [b" " + w.encode() for w in words] + [u.encode() for u in others]
        (a, n_a), (b, n_b) = self._encode_a(words, others, raw[:len(words)]), self._encode_b(words, others)
        good = self._gives_back(a, n_a, self.a_bytes, self.a_len, raw) & self._gives_back(b, n_b, self.b_bytes, self.b_len, raw)
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        names, sizes, links = self._aligned(a, n_a, b, n_b)
        # from the order of encoding to the order of numbers
        order = np.argsort(number)
        starts = _bounds(sizes[:, 3])[:-1]
        links = take_ragged(links, starts[order], sizes[order, 3])
        sizes = sizes[order]
        self.names.extend(map(names.__getitem__, order.tolist()))
        self.good = np.concatenate((self.good, good[order]))
        self.starts = np.concatenate((self.starts, len(self.links) + _bounds(sizes[:, 3])[:-1]))
        self.sizes, self.links = np.concatenate((self.sizes, sizes)), np.concatenate((self.links, links))
        self.learnt = self.known

    def _aligned(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray):
        """(text of the groups, sizes, links) of units from their tokens: all units at once."""
        units = len(n_a)
        end_a, end_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        if not len(a):
            return [b""] * units, np.zeros((units, 4), np.int64), np.empty(0, np.int64)
        # ends of both are the ends of groups; a unit's end is one of them
        at = np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)
        ends = end_a[end_b[at] == end_a]
        in_a, in_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        size_a, size_b = np.bincount(in_a, minlength=len(ends)), np.bincount(in_b, minlength=len(ends))
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        unit_of = np.searchsorted(np.cumsum(n_a), first_a, side="right")
        n_groups = np.bincount(unit_of, minlength=units)
        # every A token of a group with every B token of it
        per_a = size_b[in_a]
        links = np.repeat(a, per_a) * self.n_b + take_ragged(b, first_b[in_a], per_a)
        n_links = np.bincount(unit_of, weights=size_a * size_b, minlength=units).astype(np.int64)
        # the groups as text: A ids, then B ids, each followed by a separator
        before = np.cumsum(size_a + size_b) - size_a - size_b
        ids, sep = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[before[in_a] + np.arange(len(a)) - first_a[in_a]] = a
        ids[(before + size_a)[in_b] + np.arange(len(b)) - first_b[in_b]] = b
        sep[before + size_a - 1], sep[before + size_a + size_b - 1] = ord("|"), ord(";")
        width = self.n_digits[ids] + 1
        ends_at = np.cumsum(width)
        text = take_ragged(self.digits, ids * _DIGITS, width)
        text[ends_at - 1] = sep
        text = text.tobytes()
        tokens = _bounds(n_a + n_b)
        cut = np.concatenate(([0], ends_at))[tokens].tolist()
        return ([text[x:y] for x, y in zip(cut, cut[1:])], np.column_stack((n_a, n_b, n_groups, n_links)), links)

    def _unit_slots(self, piece: str) -> list[int]:
        if _TWO_BLANKS.search(piece) or piece[0] != " " or piece[-1].isspace():
            word, other = self.words, self.others
            return [word[u[1:]] if u[0] == " " and " " not in u[1:] and not (u[1:2].isspace() or u[-1].isspace())
                    else other[u] for u in _CUT.split(piece)]
        # usual text: blanks and line feeds stand alone between other characters
        lines = piece[1:].split("\n")
        out = list(map(self.words.__getitem__, lines[0].split(" ")))
        for line in lines[1:]:
            first, *rest = line.split(" ")
            out.append(self.others["\n"])
            out.append(self.others[first])
            out.extend(map(self.words.__getitem__, rest))
        return out

    def slots(self, texts: list[str]) -> list[np.ndarray]:
        """The slots of the units of each text, in order; empty for texts without tokens."""
        if self.known > CACHE_UNITS:
            self.shed()
        found = []
        for text in texts:
            parts = [np.array(self._unit_slots(p), np.int64) for p in (pieces_of(" " + text) if text else ())]
            found.append(np.concatenate(parts) if parts else np.empty(0, np.int64))
        self.learn()
        uses = np.bincount(np.concatenate(found), minlength=self.known) if found else np.zeros(self.known, np.int64)
        uses[:len(self.uses)] += self.uses
        self.uses = uses
        return [x[:0] if META in t or not self.good[x].all() else x for t, x in zip(texts, found)]

    def text_of(self, slots: np.ndarray) -> bytes:
        """The groups of a text."""
        return b"".join(map(self.names.__getitem__, slots.tolist()))[:-1]


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(a_json: bytes, b_model: bytes) -> Aligner:
    key = zlib.crc32(a_json), zlib.crc32(b_model)
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(a_json, b_model)
    return _ALIGNERS[key]


def _ragged(values, counts, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_bounds(counts).astype(np.int32)), pa.array(values, kind))


def _one(values, kind) -> pa.Array:
    """A column with one row: the list of ``values``."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _texts(column: pa.Array, lo: int, hi: int) -> list[str]:
    return [column[i].as_buffer().to_pybytes().decode() for i in range(lo, hi)]


def groups(docs: DataFrame, a_json: bytes, b_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, groups`` of every row, the groups as text.  A map without a shuffle."""
    files = docs.sparkSession.sparkContext.broadcast((a_json, b_model))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        al = aligner(*files.value)
        for batch in batches:
            column, offsets = text_column(batch.column(1))
            for lo, hi in slices_by_bytes(offsets, BLOCK_BYTES):
                found = al.slots(_texts(column, lo, hi))
                sizes = np.array([al.sizes[s].sum(0) for s in found], np.int64).reshape(-1, 4)
                names = [al.text_of(s).decode() for s in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, sizes.T), pa.array(names)],
                                                 [id_col, "n_a", "n_b", "n_groups", "n_links", "groups"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups string")


#: ``body`` has what only a block's own scores read, ``keys`` and ``docs`` its irregular pairs and how many of its documents hold each
_BLOCK_SCHEMA = "block long, body binary, keys array<long>, docs array<int>, same binary"


def _packed(columns: dict[str, pa.Array]) -> bytes:
    """A row of lists as one compressed Arrow stream."""
    batch, sink = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(body: pa.Buffer) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(body, options=pa.ipc.IpcReadOptions(use_threads=False)).read_next_batch()
    return {c: batch.column(c)[0].values for c in batch.schema.names}


def _blocks(files):
    """Blocks of documents: their units, the links of the units and the counts of pairs; last, the task's identity counts."""
    def run(batches):
        al = aligner(*files.value)
        identity, k, kind = np.zeros(len(al.a_bytes), np.int64), TaskContext.get().partitionId() << 32, None
        names = [c.split()[0] for c in _BLOCK_SCHEMA.split(", ")]
        i32, i64 = pa.int32(), pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            column, offsets = text_column(batch.column(1))
            for lo, hi in slices_by_bytes(offsets, BLOCK_BYTES):
                found = al.slots(_texts(column, lo, hi))
                sizes = np.array([al.sizes[s].sum(0) for s in found], np.int64).reshape(-1, 4)
                digest = [hashlib.sha256(al.text_of(s)).hexdigest() if len(s) else "" for s in found]
                doc = np.repeat(np.arange(hi - lo), list(map(len, found)))
                slots, unit = np.unique(np.concatenate(found), return_inverse=True)
                # distinct units of each document, with how often they occur
                pair, times = np.unique(doc * max(1, len(slots)) + unit, return_counts=True)
                doc, unit = np.divmod(pair, max(1, len(slots)))
                n_links = al.sizes[slots, 3]
                link = take_ragged(al.links, al.starts[slots], n_links)
                same = al.same[link // al.n_b] == link % al.n_b
                keys, number = np.unique(link[~same], return_inverse=True)
                coded = np.empty(len(link), np.int64)
                coded[~same], coded[same] = number, -1 - link[same] // al.n_b
                # documents that hold each pair, some documents at a time
                width, at = len(identity) + len(keys), np.cumsum(n_links) - n_links
                in_docs, ends = np.zeros(width, np.int64), np.cumsum(n_links[unit])
                lo_ = 0
                while lo_ < len(doc):
                    past = int(np.searchsorted(ends, (ends[lo_ - 1] if lo_ else 0) + HELD_LINKS, side="right"))
                    # whole documents: up to the one that would pass the limit, or one alone
                    hi_ = len(doc) if past >= len(doc) else int(np.searchsorted(doc, doc[past]))
                    hi_ = hi_ if hi_ > lo_ else int(np.searchsorted(doc, doc[lo_], side="right"))
                    u = unit[lo_:hi_]
                    held = np.repeat(doc[lo_:hi_], n_links[u]) * width + take_ragged(coded, at[u], n_links[u]) + len(identity)
                    in_docs += np.bincount(np.unique(held) % width, minlength=width)
                    lo_ = hi_
                identity += in_docs[:len(identity)][::-1]
                # units ascend within a document: their steps are small numbers
                body = _packed({"ids": _one(batch.column(0).slice(lo, hi - lo), kind), "sizes": _one(sizes.ravel(), i32),
                                "digest": _one(digest, pa.string()), "doc_units": _one(np.bincount(doc, minlength=hi - lo), i32),
                                "unit_steps": _one(np.diff(unit, prepend=0), i32), "times": _one(times, i32),
                                "unit_links": _one(n_links, i32), "link": _one(coded, i32)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], i64), pa.array([body], pa.binary()), _one(keys, i64), _one(in_docs[len(identity):], i32),
                     pa.nulls(1, pa.binary())], names)
                k += 1
                give_back()
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, i64), pa.nulls(1, pa.binary()), _one([], i64), _one([], i32),
                                              pa.array([identity.tobytes()], pa.binary())], names)
    return run


def _stored_blocks(rows: DataFrame, a_json: bytes, b_model: bytes, scratch: Scratch) -> DataFrame:
    files = rows.sparkSession.sparkContext.broadcast((a_json, b_model))
    with short_batches(rows.sparkSession, BATCH_ROWS):
        return scratch.write(rows.mapInArrow(_blocks(files), _BLOCK_SCHEMA), "blocks", maxRecordsPerFile=FILE_BLOCKS)


def _add_up(batches):
    total = None
    for batch in batches:
        for x in batch.column(0):
            v = np.frombuffer(x.as_buffer(), np.int64)
            total = v.copy() if total is None else total + v
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["same"])


def _identity_counts(blocks: DataFrame, size: int, scratch: Scratch) -> np.ndarray:
    """Sum of the tasks' vectors, added up in a tree until at most FAN_IN are left."""
    part, k = blocks.where("block IS NULL").select("same"), 0
    left = part.count()
    while left > FAN_IN:
        left, k = -(-left // FAN_IN), k + 1
        part = scratch.write(part.repartition(left).mapInArrow(_add_up, "same binary"), f"same-{k}")
    total = np.zeros(size, np.int64)
    for r in part.collect():   # a few rows of the vocabulary's length
        total += np.frombuffer(r["same"], np.int64)
    return total


def _score(kind: str, id_col: str, counts):
    """Rows of one block of documents from its arrays and the counts of its pairs."""
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ident, best, n_b = counts.value
        row = _unpacked(left.column("body")[0].as_buffer())
        row["keys"] = left.column("keys")[0].values
        num = {c: row[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in
               ("sizes", "doc_units", "unit_steps", "times", "unit_links", "link", "keys")}
        unit = np.cumsum(num["unit_steps"])
        count = np.zeros(len(num["keys"]), np.int64)
        count[right.column("pos").to_numpy()] = right.column("n").to_numpy()
        a_of_key, link = num["keys"] // n_b, num["link"]
        value, first = np.empty(len(link), np.int64), np.empty(len(link), np.int64)
        own = link < 0
        first[own], first[~own] = -1 - link[own], a_of_key[link[~own]]
        value[own], value[~own] = ident[first[own]], count[link[~own]]
        is_best = value == best[first]

        def sums(values, lens):
            total = np.concatenate(([0], np.cumsum(values)))
            at = _bounds(lens)
            return total[at[1:]] - total[at[:-1]]

        doc_sum = sums(sums(value, num["unit_links"])[unit] * num["times"], num["doc_units"])
        doc_best = sums(sums(is_best, num["unit_links"])[unit] * num["times"], num["doc_units"])
        sizes = num["sizes"].reshape(-1, 4)
        return pa.table([row["ids"], *map(pa.array, sizes.T), pa.array(doc_best), pa.array(doc_sum), row["digest"]],
                        [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    schema = (f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
              "groups_sha256 string")
    return run, schema


def _totals(blocks: DataFrame) -> DataFrame:
    """``key, n``: documents of the corpus that hold each irregular pair."""
    listed = blocks.select(F.explode(F.arrays_zip("keys", "docs")).alias("x")).select("x.keys", "x.docs")
    return listed.groupBy(F.col("keys").alias("key")).agg(F.sum("docs").alias("n"))


def align(docs: DataFrame, a_json: bytes, b_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``count_sum`` adds over a document's links the number of documents that hold the
    pair; ``n_best`` counts the links whose number is the highest of their A id.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    model = aligner(a_json, b_model)
    n_a, n_b = len(model.a_bytes), model.n_b
    blocks = _stored_blocks(docs.select(id_col, text_col), a_json, b_model, scratch)
    ident = _identity_counts(blocks, n_a, scratch)
    filled = blocks.where("block IS NOT NULL")
    totals = scratch.write(_totals(filled), "totals")
    settle(spark)
    best = ident.copy()
    for r in totals.groupBy(F.expr(f"key div {n_b}").alias("a")).agg(F.max("n").alias("n")).collect():  # A's vocabulary
        best[r["a"]] = max(best[r["a"]], r["n"])
    counts = spark.sparkContext.broadcast((ident, best, n_b))
    asked = filled.select(F.col("block").alias("asker"), F.posexplode("keys").alias("pos", "key"))
    answers = asked.join(totals, "key").select("asker", "pos", "n")
    run, schema = _score(kind, id_col, counts)
    return filled.drop("same", "docs").groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(run, schema)


def pair_counts(docs: DataFrame, a_json: bytes, b_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a, b, n``: every linked pair of ids with the number of documents that hold it."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    model = aligner(a_json, b_model)
    blocks = _stored_blocks(docs.select(id_col, text_col), a_json, b_model, scratch)
    ident = _identity_counts(blocks, len(model.a_bytes), scratch)
    held = np.flatnonzero(ident)
    same = spark.createDataFrame([(int(a), int(model.same[a]), int(ident[a])) for a in held], "a long, b long, n long")
    rest = _totals(blocks.where("block IS NOT NULL"))
    return same.union(rest.select(F.expr(f"key div {model.n_b}"), F.col("key") % model.n_b, "n"))
