"""Operators on repeated text against brute force over all documents."""

import hashlib
import random
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from thermoscope.llm import components, line_chunks, ngram_join, prefix_parse, sentence_spans
from thermoscope.llm.common import U64, RollingHash, Scratch, mix64

from .conftest import table

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(k, seed, bag="alpha beta gamma delta eps zeta eta theta iota kappa lamda mu nu xi".split()):
    rng = random.Random(seed)
    return [rng.choice(bag) + str(rng.randint(0, 40)) for _ in range(k)]


# --- n-gram join ---------------------------------------------------------------

def shingle_set(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(pairs, n, percent):
    """{id: (size, component)} by comparing all pairs."""
    sets = [(i, shingle_set(t, n)) for i, t in pairs if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, u) = sets[a], sets[b]
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def assert_components(df, pairs, n=ngram_join.N, percent=ngram_join.PERCENT):
    want = brute_components(pairs, n, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect() if r["doc_id"] is not None}
    assert got == want


def test_op1_query(spark, documents):
    assert_components(entry.queries()["op1_ngram_join"](spark, SMALL), list(zip(documents.doc_id, documents.text)))


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_ngram_join_hot_groups(docs_of, n, percent, monkeypatch):
    """Chains of near copies, many copies and shingles in most sets, with hub rounds and the pairs after them."""
    monkeypatch.setattr(ngram_join, "HOT", 4)
    rng, base, texts = random.Random(3), words_of(90, 1), []
    for k in range(60):   # each a few words away from the template, so only some link
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"own{k}{rng.random()}"
        texts.append(" ".join(w))
    w = words_of(70, 9)
    for k in range(12):   # a chain: neighbours link, the ends do not
        w = list(w)
        w[k * 5] = f"c{k}"
        texts.append(" ".join(w).upper() if k % 2 else "  ".join(w))
    texts += [" ".join(base)] * 7 + [None, "", " \n", "one", "one", "ONE", "one two", "x y z"]
    pairs = list(enumerate(texts))
    assert_components(ngram_join.link(docs_of(texts, 5), n=n, percent=percent), pairs, n, percent)


def test_ngram_join_edges(spark, docs_of):
    assert ngram_join.link(docs_of([])).count() == 0
    rows = ngram_join.link(docs_of([(None, "a b c d e"), (None, None), (4, "a b c d e"), (4, "a b c d e"), (2, None)])).collect()
    assert len(rows) == 5
    assert sorted((r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] is not None) == [(2, 2), (4, 4), (4, 4)]
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    kept = ngram_join.keep_first(docs_of([(None, "a"), (4, "p q r s t"), (9, "p q r s t"), (2, "")]))
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 4]
    assert kept.columns == docs_of([]).columns


def test_keep_first_loses_no_text_and_no_column(spark):
    rows = [(1, "p q r s t u", "a"), (1, "v w x y z a", "b"), (1, "p q r s t u", "c"), (2, "p q r s t u", "d"), (None, "x", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _first string")
    kept = ngram_join.keep_first(df)
    assert kept.columns == df.columns
    got = sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect())
    assert got == [(-1, "x"), (1, "p q r s t u"), (1, "v w x y z a")]


def test_decontaminate_with_clashing_columns(spark):
    from thermoscope.llm import decontaminate
    docs = spark.createDataFrame([(1, "one two three four five six", "a"), (2, "other words", "b")],
                                 "doc_id long, text string, _hit string")
    items = spark.createDataFrame([(7, "one two three four five six")], "item_id long, text string")
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns and [r["doc_id"] for r in left.collect()] == [2]


def test_components_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 200), (200, 250)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(tuple(r) for r in components.components(df, Scratch(spark), "t").collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(50))
    assert got[300] == got[250] == got[200] == 200
    assert components.components(df.limit(0), Scratch(spark), "t").count() == 0


# --- sentence spans --------------------------------------------------------------

def brute_runs_of_units(n, words, size, least):
    """(first, end) of the shortest runs of ``size`` units and ``least`` words, grown forward and backward from every unit."""
    found = set()
    for i in range(n):
        j = next((j for j in range(i + size, n + 1) if sum(words[i:j]) >= least), None)
        if j is not None:
            found.add((i, j))
        j = next((j for j in range(i + 1 - size, -1, -1) if sum(words[j:i + 1]) >= least), None)
        if j is not None:
            found.add((j, i + 1))
    return found


def brute_spans(pairs):
    """Units of each text alone, plain searches for its runs, and runs compared by their texts."""
    seen, out = set(), {}
    hasher = RollingHash(41)
    for i, t in sorted(pairs):
        raw = (t or "").encode()
        data = np.frombuffer(raw, np.uint8)
        _, start, end, words, begins = (x.tolist() for x in sentence_spans.units(data, np.array([0, len(raw)]), hasher))
        n, first = len(start), [k for k, x in enumerate(begins) if x]
        edge = [*first, n]
        per_sentence = [sum(words[x:y]) for x, y in zip(edge, edge[1:])]
        spans = {(edge[x], edge[y]) for x, y in brute_runs_of_units(len(first), per_sentence, sentence_spans.RUN,
                                                                   sentence_spans.MIN_WORDS)}
        for x, y in brute_runs_of_units(n, words, 1, sentence_spans.PAIR_WORDS):
            if not (x in edge and y in edge and edge.index(y) - edge.index(x) >= sentence_spans.RUN):
                spans.add((x, y))
        gone = [False] * n
        for x, y in sorted(spans):
            key = tuple(raw[start[k]:end[k]] for k in range(x, y))
            if key in seen:
                gone[x:y] = [True] * (y - x)
            seen.add(key)
        cut = [*start, len(raw)]
        kept = raw[:cut[0]] + b"".join(raw[cut[k]:cut[k + 1]] for k in range(n) if not gone[k])
        out[i] = (len(first), sum(any(gone[x:y]) for x, y in zip(edge, edge[1:])), kept.decode())
    return out


def assert_spans(df, pairs):
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["text"]) for r in df.collect()}
    assert got == brute_spans(pairs)


def test_op4_query(spark, documents):
    assert_spans(entry.queries()["op4_sentence_spans"](spark, SMALL), list(zip(documents.doc_id, documents.text)))


def test_sentence_spans_small(docs_of):
    passage = 'The first one stands here. "Is the second one long?" Yes it is.\nAnd a fourth sentence follows it!'
    texts = [None, "", " \n ", "No stop here", f"Intro words are own. {passage} Tail one.", f"{passage}",
             f"  Other head text. {passage} {passage}", "A. B. C. A. B. C. A. B. C.", "Éa. Ö! ü? " * 9,
             "word " * 20 + "end. " + "more " * 20 + "end.", "x. " + "word " * 20 + "end. " + "more " * 20 + "end. y."]
    assert_spans(sentence_spans.deduplicate(docs_of(texts)), list(enumerate(texts)))
    assert sentence_spans.deduplicate(docs_of([])).count() == 0
    twice = sentence_spans.deduplicate(docs_of([(1, passage), (1, passage), (None, passage)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in twice) == [(0, 0), (1, 4), (1, 4)]


# --- line chunks -------------------------------------------------------------------

def brute_chunks(pairs):
    """Chunks between hash boundaries and from one line with words to the next, compared by their bytes."""
    hasher, seen, out = RollingHash(47), set(), {}

    def line_hash(b):
        a = np.frombuffer(b, np.uint8)
        return int(hasher.span(hasher.prefix(a), np.array([0]), np.array([len(a)]))[0])

    for i, t in sorted(pairs):
        lines = (t or "").encode().split(b"\n")
        h, n, a, gone, spans = [line_hash(x) for x in lines], len(lines), 0, set(), set()
        inked = [k for k in range(n) if lines[k].split()]
        hit = [k > 0 and int(mix64(np.array([(h[k - 1] * 0x9E3779B97F4A7C15 + h[k]) % 2**64], U64))[0])
               % line_chunks.MEAN_LINES == 0 for k in range(n)]
        for k in range(n):
            if k == n - 1 or (hit[k] and not (k and hit[k - 1]) and k <= n - 3):
                if sum(a <= x <= k for x in inked) >= 2:
                    spans.add((a, k + 1))
                a = k + 1
        spans |= {(x, y + 1) for x, y in zip(inked, inked[1:])}
        for x, y in sorted(spans):
            key = tuple(lines[x:y])
            if key in seen:
                gone |= set(range(x, y))
            seen.add(key)
        out[i] = (n, len(gone), b"\n".join(x for k, x in enumerate(lines) if k not in gone).decode())
    return out


def assert_chunks(df, pairs):
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in df.collect()}
    assert got == brute_chunks(pairs)


def test_op8_query(spark, documents):
    assert_chunks(entry.queries()["op8_line_chunks"](spark, SMALL), list(zip(documents.doc_id, documents.text)))


def test_line_chunks_small(docs_of):
    block = "\n".join(f"line number {k} of the block" for k in range(30))
    texts = [None, "", "\n\n\n", "one line", block, "head\n" + block + "\ntail", block + "\nx", "\n".join(["same"] * 9),
             block.replace("number 7 ", "number seven "), "é\nö\né\nö"]
    df = line_chunks.deduplicate(docs_of(texts))
    assert_chunks(df, list(enumerate(texts)))
    got = table(df)
    assert got[5]["n_removed"] >= 10 and got[8]["n_removed"] >= 10   # boundaries resist shifts and edits
    assert line_chunks.deduplicate(docs_of([])).count() == 0


def test_line_chunks_clean_keeps_columns(docs_of):
    block = "\n".join(f"line number {k} of the block" for k in range(30))
    df = docs_of([block, block, None, "", "own text", (None, block)])
    got = line_chunks.clean(df)
    assert got.columns == df.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert set(rows) == {None, 2, 3, 4} and rows[None]["text"] == block and rows[2]["text"] is None
    assert rows[4]["row"] == "r" and rows[4]["spans"] is None


# --- repeated byte strings -----------------------------------------------------------

def brute_bytes(pairs):
    seen, out = set(), {}
    for i, t in sorted(pairs):
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s:s + 100]
            if w in seen:
                mask[s:s + 100] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        runs = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
        out[i] = (len(b), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def assert_bytes(df, pairs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}
    assert got == brute_bytes(pairs)


def test_op10_query(spark, documents):
    assert_bytes(entry.queries()["op10_prefix_parse"](spark, SMALL), list(zip(documents.doc_id, documents.text)))


def test_prefix_parse_small(docs_of):
    rng = random.Random(8)
    noise = lambda k: "".join(rng.choice("abcdefghij é") for _ in range(k))
    p, q = noise(160), noise(99)
    texts = [None, "", "short", p, noise(40) + p[10:130] + noise(30), p[:99], p[:100], q + noise(5), noise(5) + q,
             "ab" * 400, "b" + "ab" * 120, "x" * 99, "x" * 230, noise(60) + p + p + noise(9), p[30:] + p[:60]]
    texts += [noise(rng.randint(0, 60)) + p[rng.randint(0, 30):rng.randint(110, 160)] + noise(30) for _ in range(40)]
    assert_bytes(prefix_parse.deduplicate(docs_of(texts, 4)), list(enumerate(texts)))
    assert prefix_parse.deduplicate(docs_of([])).count() == 0
    rows = prefix_parse.deduplicate(docs_of([(1, p), (1, p), (None, p)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in rows) == [(0, 0), (1, len(p.encode())), (1, len(p.encode()))]


def test_triggers_across_position_blocks(monkeypatch):
    """A text longer than the room for positions has the same triggers in one piece or many."""
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 6000).astype(np.uint8)
    data[1000:2500] = 97
    offsets = np.array([0, 40, 3000, 3100, 6000])
    hashers = prefix_parse._hashers()
    h = hashers[0].windows(hashers[0].prefix(data), prefix_parse.K)
    h &= ~U64((1 << 24) - 1)
    whole = prefix_parse.triggers(data, offsets, h)[0]
    monkeypatch.setattr(prefix_parse, "POSITION_BITS", 10)
    assert np.array_equal(prefix_parse.triggers(data, offsets, h)[0], whole)
    reach, want = prefix_parse.LENGTH - prefix_parse.K + 1, set()
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        for s in range(lo, hi - prefix_parse.LENGTH + 1):
            want.add(s + min(range(reach), key=lambda j: (int(h[s + j]), -j)))
    assert sorted(want) == whole.tolist()


def test_suffix_classes_order():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 700).astype(np.uint8)
    starts = np.arange(0, 700 - 20)
    got = prefix_parse.suffix_classes(data, starts, 20)
    text = data.tobytes()
    want = {s: r for r, s in enumerate(sorted({text[i:i + 20] for i in starts}))}
    assert got.tolist() == [want[text[i:i + 20]] for i in starts]


def test_ngram_counts_are_stored_before_the_entries(docs_of, monkeypatch):
    """The shuffle of the shingle counts ends before the entries are written (both were in one write), and both tables go."""
    from thermoscope.llm import ngram_join
    seen = []
    write, drop = ngram_join.Scratch.write, ngram_join.Scratch.drop
    monkeypatch.setattr(ngram_join.Scratch, "write", lambda s, df, name: seen.append(name) or write(s, df, name))
    monkeypatch.setattr(ngram_join.Scratch, "drop", lambda s, name: seen.append(f"-{name}") or drop(s, name))
    out = ngram_join.link(docs_of([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z u v w")])).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {1: 1, 2: 1, 3: 3}
    at = [seen.index(x) for x in ("listed", "counts", "entries", "-listed", "-counts")]
    assert at == sorted(at)
