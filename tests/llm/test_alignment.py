"""Cross-tokenizer alignment, periodic runs and SimHash against brute force over all documents."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

import __spark_entry__ as entry
from thermoscope.llm import periodic_runs, simhash, token_align

from .conftest import table

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ODD = [None, "", " ", "\n", "a\n\nb", "a\nb c\n", "\nx", "  two  blanks ", "áb  ́c <|endoftext|>x\n\nİΣς don't it's \x1c x\t　z\x00",
       "ﬁ 가각\r\nẛ̣  q", "Hello▁world", "🤗🤗 日本語 <s> <0x0A>", " " * 90 + "x" + " " * 37, "ab" * 400, "the the the the",
       "word, word; \n word! (word) [x]", "a \nb", "x\n y", "é\ń ́", "\u0085a \u0085 b  c", "<unk> </s>"]


# --- alignment -----------------------------------------------------------------

class BruteAlignment:
    """Whole texts through both libraries, groups by a walk over the two lists of ends."""

    def __init__(self, proto):
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.decoders import ByteLevel
        self.a = Tokenizer.from_buffer(proto("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=proto("piece_bpe_32k.model"))
        table = token_align._byte_alphabet()
        self.a_bytes = {i: bytes(table[c] for c in t) for t, i in self.a.get_vocab().items() if set(t) <= set(table)}
        # the byte alphabet against the library's own decoder
        assert all(ByteLevel().decode([t]) == self.a_bytes[i].decode(errors="replace") for t, i in self.a.get_vocab().items()
                   if i in self.a_bytes)

    def piece_bytes(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        raw = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        x, y = [self.a_bytes[i] for i in a], [self.piece_bytes(i) for i in b]
        if b"".join(x) != raw or b"".join(y) != raw:
            return []
        out, i, j, ga, gb, ea, eb = [], 0, 0, [], [], 0, 0
        while i < len(a) or j < len(b):
            if ea <= eb and i < len(a):
                ga.append(a[i]); ea += len(x[i]); i += 1   # noqa: E702
            else:
                gb.append(b[j]); eb += len(y[j]); j += 1   # noqa: E702
            if ea == eb and ga and gb:
                out.append((ga, gb))
                ga, gb = [], []
        return out

    def rows(self, pairs):
        found = [(d, self.groups(t)) for d, t in pairs]
        count = Counter(p for _, gs in found for p in {(a, b) for x, y in gs for a in x for b in y})
        best = defaultdict(int)
        for (a, _), n in count.items():
            best[a] = max(best[a], n)
        out = []
        for d, gs in found:
            links = [(a, b) for x, y in gs for a in x for b in y]
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
            out.append((d, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(links),
                        sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
                        hashlib.sha256(text.encode()).hexdigest() if gs else ""))
        return out, count


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def brute(proto):
    return BruteAlignment(proto)


def rows_of(df, columns=COLUMNS):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_op11_query(spark, brute, documents):
    want, _ = brute.rows(list(zip(documents.doc_id.tolist(), documents.text)))
    assert rows_of(entry.queries()["op11_token_align"](spark, SMALL)) == sorted(want, key=str)


def test_alignment_odd_texts(docs_of, brute, proto, documents, monkeypatch):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("aeioTHns \n é,.'1") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    files = proto("byte_bpe_50k.json"), proto("piece_bpe_32k.model")
    pairs = [*enumerate(texts), (3, "again"), (3, "again"), (None, "no id")]
    want, count = brute.rows(pairs)
    assert rows_of(token_align.align(docs_of(pairs), *files)) == sorted(want, key=str)
    got = {(r["a"], r["b"]): r["n"] for r in token_align.pair_counts(docs_of(pairs), *files).collect()}
    assert got == dict(count)
    shown = table(token_align.groups(docs_of(list(enumerate(texts))), *files))
    for i, t in enumerate(texts):
        assert shown[i]["groups"] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in brute.groups(t))
    assert token_align.align(docs_of([]), *files).count() == 0


def test_units_in_pieces_and_small_caches(brute, proto, documents, monkeypatch):
    """Small blocks, caches and pieces of a text change nothing."""
    model = token_align.Aligner(proto("byte_bpe_50k.json"), proto("piece_bpe_32k.model"))
    monkeypatch.setattr(token_align, "CHUNK_CHARS", 64)
    monkeypatch.setattr(token_align, "CACHE_UNITS", 50)
    for text in documents.text.tolist()[:60]:
        found, = model.slots([text])
        want = brute.groups(text)
        assert model.text_of(found).decode() == ";".join(
            ",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want)


def test_merger_equals_library(proto, documents):
    """The faster merger against the tokenizers library: every entry's own text, all documents, odd texts."""
    model = token_align.Aligner(proto("byte_bpe_50k.json"), proto("piece_bpe_32k.model"))
    own = [b.decode() for b in model.a_bytes if b.decode(errors="ignore").encode() == b]
    texts = own + [t for t in ODD if t] + documents.text.tolist()
    want = [e.ids for e in model.a.encode_batch(texts, add_special_tokens=False)]
    assert model.merger is not None and [model.merger.encode_ordinary(t) for t in texts] == want


def test_identity_map_has_the_same_bytes(proto):
    model = token_align.Aligner(proto("byte_bpe_50k.json"), proto("piece_bpe_32k.model"))
    held = np.flatnonzero(model.same >= 0)
    assert len(held) > 10_000
    assert all(model.a_bytes[a] == model.b_bytes[model.same[a]] for a in held)


# --- periodic runs -------------------------------------------------------------

def brute_runs(w, least=24, repeats=3):
    """Runs of every period by comparing words directly."""
    out, n = [], len(w)
    for q in range(1, n // repeats + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, size = i - q, j - i + q
            if j > i and size >= max(least, repeats * q) and not any(
                    all(w[k] == w[k - p] for k in range(s + p, s + size)) for p in range(1, q)):
                out.append((s, size, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def run_row(doc_id, words):
    runs = brute_runs(words)
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = None
    for s, size, q in runs:
        if best is None or size * best[2] > best[1] * q:
            best = (s, size, q)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest())


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_op12_query(spark, documents):
    short = documents[documents.text.str.len() < 6000]
    got = table(entry.queries()["op12_periodic_runs"](spark, SMALL))
    assert len(got) == len(documents)
    want = {d: run_row(d, planted(d, WORD.findall(t or ""))) for d, t in zip(short.doc_id.tolist(), short.text)}
    assert {d: tuple(got[d][c] for c in RUN_COLUMNS) for d in want} == want
    assert sum(r[1] > 0 for r in want.values()) > 5


def test_find_runs_random():
    rng = random.Random(1)
    for _ in range(1500):
        least, repeats = rng.choice([24, 24, 6, 9, 3, 1, 12, 30]), rng.choice([3, 3, 4, 5])
        w = []
        for _ in range(rng.randint(1, 5)):
            u = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 12))]
            if rng.random() < 0.3:
                u = u * rng.randint(1, 3) + [rng.randint(0, 3)]
            w += u * rng.randint(1, 7)
        w = w[:150]
        got = periodic_runs.find_runs(np.array(w, np.int64), least, repeats)
        assert [tuple(r) for r in got.tolist()] == brute_runs(w, least, repeats)
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(5, np.int64), 3, 2)


def test_runs_edges(docs_of, monkeypatch):
    monkeypatch.setattr(periodic_runs, "SLICE_BYTES", 200)
    rng = random.Random(2)
    u = [f"w{rng.randint(0, 9)}" for _ in range(400)]
    texts = [None, "", " \n ", "a " * 30, "a " * 24, "a " * 23, "\t" + "a\nb " * 12, "x y z " * 400, " ".join(u * 3),
             "a " * 40 + "b " + "a " * 40, " ".join(u[:100]), "é \x85 é \x85 " * 9]
    pairs = [*enumerate(texts), (7, "x y z " * 400), (None, "q " * 30)]
    got = sorted((tuple(r[c] for c in RUN_COLUMNS) for r in periodic_runs.digests(periodic_runs.collapse(docs_of(pairs))).collect()),
                 key=str)
    assert got == sorted((run_row(d, WORD.findall(t or "")) for d, t in pairs), key=str)
    shown = table(periodic_runs.collapse(docs_of(texts)))
    assert shown[9]["collapsed"] == "a b a" and shown[0]["collapsed"] == "" and shown[0]["n_words"] == 0
    assert periodic_runs.collapse(docs_of([])).count() == 0


def test_long_text_of_one_word_is_not_quadratic(docs_of):
    got = table(periodic_runs.collapse(docs_of(["a " * 400_000, "a b " * 200_000 + "c"])))
    assert [tuple(r) for r in got[0]["runs"]] == [(0, 400_000, 1)] and got[0]["collapsed"] == "a"
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 400_000, 2)] and got[1]["collapsed"] == "a b c"


# --- SimHash -------------------------------------------------------------------

def brute_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    """{id: smallest reachable id} by comparing all pairs of fingerprints."""
    ids = [(i, f) for i, f in fps if i is not None]
    root = {i: i for i, _ in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, f) in enumerate(ids):
        for j, g in ids[:k]:
            if (f ^ g).bit_count() <= 4:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in ids}


def test_op13_query(spark, documents):
    fps = [(d, brute_fingerprint(t)) for d, t in zip(documents.doc_id.tolist(), documents.text)]
    classes = brute_classes(fps)
    got = table(entry.queries()["op13_simhash"](spark, SMALL))
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {
        d: (f"{f:016x}", classes[d]) for d, f in fps}


def test_simhash_edges(docs_of, monkeypatch):
    monkeypatch.setattr(simhash, "N", 4)
    base = [f"Word{i}" for i in range(60)]
    texts = [None, "", " \t ", "one", "ONE", "one two three", "one  two\nthree four", " ".join(base), " ".join(base[:-1]),
             " ".join(base * 50), "é À", "É à"]
    pairs = [*enumerate(texts), (7, " ".join(base)), (None, "")]
    got = simhash.link(docs_of(pairs)).collect()
    assert len(got) == len(pairs)
    fps = [(d, brute_fingerprint(t)) for d, t in pairs]
    classes = brute_classes(fps)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted(
        (d, f"{f:016x}", classes[d]) for d, f in fps if d is not None)
    assert [(r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is None] == [("0" * 16, None)]
    assert simhash.link(docs_of([])).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    from thermoscope.llm import words
    rng = random.Random(4)
    text = " ".join(rng.choice(("A", "bb", "Ccc")) + str(rng.randint(0, 99)) for _ in range(500)).replace("b ", "b\n\n")
    want = brute_fingerprint(text)
    for size in (1, 7, 100, 10**6):
        monkeypatch.setattr(words.word_chunks, "__defaults__", (size,))
        assert simhash.fingerprint(text.encode()) == want
        assert [w for c in words.word_chunks(text.encode()) for w in c] == text.encode().split()


@pytest.mark.parametrize("crowd", [1, 4, 10**6])
def test_links_of_dense_and_sparse_fingerprints(spark, docs_of, monkeypatch, crowd):
    """Clouds of fingerprints around a few centres: crowded keys give the same classes as single pairs."""
    rng = random.Random(crowd)
    fps = []
    for c in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 6 if c % 2 else 3)):
                f ^= 1 << b
            fps.append(f)
    fps += [rng.getrandbits(64) for _ in range(60)] + [0, 1, 3, 2**63, 2**64 - 1]
    rng.shuffle(fps)
    rows = list(enumerate(fps))
    made = spark.createDataFrame([(i, simhash._signed(f)) for i, f in rows], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **k: made)
    got = {r["doc_id"]: r["component_id"] for r in simhash.link(docs_of([]), crowd=crowd).collect()}
    assert got == brute_classes(rows)


def test_tables_of_fingerprints_are_not_broadcast(spark):
    """Spark sizes an exploded table like its fingerprints: both joins sent millions of entries through the driver."""
    fps = spark.range(500).select(F.xxhash64("id").alias("fp"))
    for df in (simhash.table_links(simhash.entries(fps)), simhash.crowd_links(fps)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_usual_units_stay_when_units_are_shed(proto, monkeypatch):
    """A worker keeps the units it met most often (it forgot all of them before) and still aligns texts alike."""
    model = token_align.Aligner(proto("byte_bpe_50k.json"), proto("piece_bpe_32k.model"))
    monkeypatch.setattr(token_align, "CACHE_UNITS", 30)
    monkeypatch.setattr(token_align, "KEPT_UNITS", 5)
    first = model.text_of(model.slots(["often seen words " * 9])[0])
    model.slots([" ".join(f"rare{i}" for i in range(40))])
    again, = model.slots(["often seen words " * 9])
    assert model.text_of(again) == first
    assert {"seen", "words"} <= set(model.words) and model.known <= 6


def test_blocks_travel_packed(spark, brute, docs_of, proto, documents, monkeypatch):
    """Only pairs are array columns (a block's units were too, at several times their size in the reader); files hold few blocks."""
    monkeypatch.setattr(token_align, "BLOCK_BYTES", 1 << 16)
    monkeypatch.setattr(token_align, "FILE_BLOCKS", 3, raising=False)
    write, kept = token_align.Scratch.write, {}
    monkeypatch.setattr(token_align.Scratch, "write",
                        lambda self, df, name, **options: kept.setdefault(name, write(self, df, name, **options)))
    pairs = [*zip(documents.doc_id.tolist(), documents.text), (None, "no id"), (3, "")]
    got = rows_of(token_align.align(docs_of(pairs).coalesce(1), proto("byte_bpe_50k.json"), proto("piece_bpe_32k.model")))
    blocks = kept["blocks"]
    assert {f.name for f in blocks.schema if f.dataType.typeName() == "array"} == {"keys", "docs"}
    n, size = blocks.where("block IS NOT NULL").selectExpr("count(*)", "sum(length(body))").first()
    assert n > 6 and size < sum(len((t or "").encode()) for _, t in pairs)
    assert blocks.selectExpr("_metadata.file_path AS file").groupBy("file").count().agg({"count": "max"}).first()[0] <= 3
    assert got == sorted(brute.rows(pairs)[0], key=str)


def test_workers_get_short_batches(spark, docs_of, proto, documents, monkeypatch):
    """A batch is held by Spark and by the worker: it has BATCH_ROWS rows at most (10,000 before), and the session's setting stays."""
    monkeypatch.setattr(token_align, "BATCH_ROWS", 10, raising=False)
    write, kept = token_align.Scratch.write, {}
    monkeypatch.setattr(token_align.Scratch, "write",
                        lambda self, df, name, **options: kept.setdefault(name, write(self, df, name, **options)))
    setting = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = docs_of(documents.text.tolist()[:45]).coalesce(1)
    token_align.align(docs, proto("byte_bpe_50k.json"), proto("piece_bpe_32k.model"))
    assert kept["blocks"].where("block IS NOT NULL").count() >= 5
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == setting
