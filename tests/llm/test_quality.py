"""Quality rules, language, decontamination, page text and the pipeline."""

import collections
import random
import re

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from thermoscope.llm import decontaminate, html_paths, lang_cnn, quality_rules

from .conftest import table

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


# --- quality rules ---------------------------------------------------------------

def brute_counts(t):
    t = t or ""
    w = WORD.findall(t)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if c[(w[i], w[i + 1], w[i + 2])] > 1 for j in (i, i + 1, i + 2)}
    seen, doubled = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            doubled += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), doubled, len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_op2_query(spark, documents):
    got = table(entry.queries()["op2_quality_rules"](spark, SMALL))
    for d, t in zip(documents.doc_id, documents.text):
        assert tuple(got[d][c] for c in COUNTS) == brute_counts(t)
        assert not (got[d]["base_failed"] and got[d]["kept"])


def test_op2_agrees_with_labels(spark):
    """Labels are never read by the rules; the verdict must still tell clean from junk documents."""
    got = entry.queries()["op2_quality_rules"](spark, MID).toPandas()
    m = pd.read_parquet(f"{MID}/labels.parquet").rename(columns={"quality": "label"}).merge(got, on="doc_id")
    m = m[~m.base_failed & m.label.notna()]
    assert (m.kept[m.label == 1]).mean() > 0.97
    assert (~m.kept[m.label == 0]).mean() > 0.9


def test_quality_edges(docs_of):
    texts = [None, "", " \n\t", "a b a b a b a b", "x y z x y z\n\nx y z x y z\nx y z x y z", "é#*$ |<>& %", "w " * 400]
    got = table(quality_rules.judge(docs_of(texts + [(3, texts[3]), (None, "lone words here")])))
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in COUNTS) == brute_counts(t)
    assert got[None]["n_words"] == 3
    assert quality_rules.judge(docs_of([])).count() == 0


def em_by_hand(patterns, names, rounds):
    """The same latent-class fit over (votes, n) in plain Python."""
    start, smooth, least = quality_rules.START, quality_rules.SMOOTH, quality_rules.LEAST
    prior, rates = 0.7, {j: (start["good"], start["bad"]) for j in names}
    for _ in range(rounds):
        post = []
        for v, n in patterns:
            g, b = prior, 1 - prior
            for j in names:
                for k, r in enumerate(rates[j]):
                    f = {1: r[0], 0: r[1], None: 1 - r[0] - r[1]}[v[j]]
                    g, b = (g * f, b) if k == 0 else (g, b * f)
            post.append(g / (g + b))
        total, good = sum(n for _, n in patterns), sum(n * p for (_, n), p in zip(patterns, post))
        prior = min(max(good / total, 0.02), 0.98)
        for j in names:
            new = []
            for k, size, weight in (("good", good, post), ("bad", total - good, [1 - p for p in post])):
                r = [max((sum(n * p for (v, n), p in zip(patterns, weight) if v[j] == x) + smooth * s) / (size + smooth), least)
                     for x, s in zip((1, 0), start[k])]
                room = (1 - least) / max(sum(r), 1 - least)
                new.append([x * room for x in r])
            new[1][0] = min(new[1][0], new[0][0])
            new[0][1] = min(new[0][1], new[1][1])
            rates[j] = tuple(map(tuple, new))
    return prior, rates


def test_em_equals_plain_python(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "ROUNDS", 6)
    monkeypatch.setattr(quality_rules, "TOLERANCE", 0.0)
    rng, names = random.Random(1), ["v_a", "v_b", "v_c"]
    patterns = [({j: rng.choice([1, 0, None]) for j in names}, rng.randint(1, 90)) for _ in range(20)]
    df = spark.createDataFrame([(*(v[j] for j in names), n) for v, n in patterns],
                               "v_a tinyint, v_b tinyint, v_c tinyint, n long")
    got = quality_rules.fit(df, names)
    prior, rates = em_by_hand(patterns, names, 6)
    assert got["prior"] == pytest.approx(prior)
    for j in names:
        assert np.allclose(got["rates"][j], rates[j])


# --- language ----------------------------------------------------------------------

def test_op6_held_out_accuracy(spark):
    got = entry.queries()["op6_lang_cnn"](spark, MID).toPandas()
    docs = pd.read_parquet(f"{MID}/documents.parquet")
    m = got.merge(docs[["doc_id", "lang"]], on="doc_id")
    assert len(m) == len(docs) and m.score.between(0, 1).all()
    assert (m.lang_pred[m.held_out] == m.lang[m.held_out]).mean() > 0.97
    import zlib
    assert (m.held_out == m.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)).all()


def test_network_gradients_are_right():
    rng = np.random.default_rng(0)
    net = lang_cnn.ByteConvNet(["a", "b", "c"], seed=3)
    x, y = rng.integers(0, lang_cnn.N_CLASSES, (5, lang_cnn.WINDOW)), np.array([0, 1, 2, 1, 0])
    grads = net._gradients(x, y)

    def loss():
        return -np.log(net.predict(x)[np.arange(5), y].astype(np.float64)).mean()

    for p, g in zip([*net.conv, net.bias, net.out, net.out_bias], grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = p[at], 1e-2
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert (up - down) / (2 * eps) == pytest.approx(g[at], rel=0.1, abs=1e-3)


def test_language_edges(spark, docs_of):
    from pyspark.sql import functions as F
    texts = ["the thing and the other", None, "", "12 34 !!", "der und die das", "中文字符", "é", "x" * 1000] * 3
    df = docs_of(texts).withColumn("lang", F.when(F.col("doc_id") % 8 == 0, "en").when(F.col("doc_id") % 8 == 4, "de"))
    got = table(lang_cnn.identify(df))
    for i, t in enumerate(texts):
        none = t is None or not any(c.isalpha() for c in t)
        assert (got[i]["lang_pred"] == "und") == none and (got[i]["score"] == 0) == none
        assert got[i]["lang_pred"] in ("en", "de", "und")
    assert lang_cnn.identify(df.limit(0)).count() == 0
    unlabelled = lang_cnn.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}
    kept = lang_cnn.keep_determined(df, lang_cnn.train(df))
    assert kept.columns == df.columns and kept.count() == 15


# --- decontamination ---------------------------------------------------------------

def brute_contained(docs, items, n=5, share=80):
    def cut(t):
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", (t or "").lower()) if x]
        return {" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    sets = [(i, cut(t)) for i, t in items]
    out = set()
    for d, t in docs:
        s = cut(t)
        for i, u in sets:
            if u and 100 * len(s & u) >= share * len(u):
                out.add((d, i, len(u), len(s & u)))
    return out


def test_contained_equals_brute_force(spark, docs_of):
    rng = random.Random(6)
    text = lambda k: " ".join(f"w{rng.randint(0, 300)}" for _ in range(k))
    items = [(k, text(rng.randint(1, 60))) for k in range(60)] + [(60, None), (61, ""), (62, "tiny item"), (63, "tiny item")]
    docs = [None, "", "Tiny  ITEM", "a tiny item inside"]
    for _, t in items[:60]:
        w = t.split()
        docs.append(text(rng.randint(0, 900)) + " " + t.upper() + "\n" + text(rng.randint(0, 300)))
        for _ in range(2):   # edited copies around the threshold
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = "edit"
            docs.append(text(30) + " " + " ".join(v) + " " + text(30))
    df = docs_of(docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.contained(df, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_contained(list(enumerate(docs)), items)
    clean = decontaminate.decontaminate(df, bench)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(docs))) - {g[0] for g in got}
    assert decontaminate.contained(df.limit(0), bench).count() == 0
    assert decontaminate.contained(df, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == len(docs)
    lone = docs_of([(None, "tiny item"), (1, "x")])
    assert [tuple(r)[:2] for r in decontaminate.contained(lone, bench.where("item_id = 62")).collect()] == [(None, 62)]
    assert decontaminate.decontaminate(lone, bench).count() == 1


# --- page text -------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page-7">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home<li><a href=/x>More</a></ul></nav>
<div class="col-12 post"><article><h1>Head &amp; line</h1><p>First <b>bold</b>word &eacute;&#33;<p>Second
  para<br>graph<script>var t="</p></article>";</script><!-- <p>no</p> --> end.
<form><input><label>Name</label></form><div class="share-bar">Share!</div>
<section class="comments"><p>Nice post</p></section></article></div>
<aside>Side text that is long enough to matter here</aside><div id="cookie-notice">We use cookies</div><footer>&copy; x</footer></body></html>"""


def test_main_text_rules(spark):
    rows = [(1, "http://h.example/a", PAGE), (2, "HTTP://H.example/b", PAGE.replace("7", "9")), (3, None, None),
            (4, "http://h.example/c", ""), (5, "odd", "plain text &lt;only"), (6, "http://k.example", "<p>a<p>b &nbsp; c</div>d"),
            (1, "http://h.example/a", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = table(html_paths.main_text(df), "page_id")
    want = "Head & line First boldword é! Second para graph end."
    assert got[1]["text"] == got[2]["text"] == want
    assert got[3]["text"] == got[4]["text"] == "" and got[5]["text"] == "plain text <only"
    assert got[6]["text"] == "a b c d"
    assert html_paths.main_text(df).count() == len(rows) and html_paths.main_text(df.limit(0)).count() == 0


def test_host_consensus_beats_one_page(spark):
    """A page whose advert outweighs its article still follows its host."""
    body = "<div class='box'>{}</div><div class='body-1'><p>{}</p></div>"
    pages = [(k, "http://a.example/x", body.format("buy now", "word " * 40)) for k in range(9)]
    pages.append((9, "http://a.example/y", body.format("buy " * 300, "short article")))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert table(html_paths.main_text(df), "page_id")[9]["text"] == "short article"


def test_op7_query(spark):
    import html
    got = table(entry.queries()["op7_html_paths"](spark, SMALL), "page_id")
    pages = pd.read_parquet(f"{SMALL}/pages.parquet")
    assert len(got) == len(pages)
    for i, url, page in zip(pages.page_id, pages.url, pages.html):
        inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)   # the template of these pages
        text = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())
        assert (got[i]["url"], got[i]["text"], got[i]["n_chars"]) == (url, text, len(text))


# --- pipeline ------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    """Each stage against brute force on its own input."""
    from .test_repeats import brute_chunks, brute_components
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_duplicates", "decontamination", "pieces"]
    frames = [docs.toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, spark.createDataFrame(frames[-1], docs.schema), SMALL)
        if k < 4:
            assert out.columns == columns
        frames.append(out.toPandas())
    raw, spoken, lines, near, clean, coded = frames
    assert set(spoken.doc_id) == {d for d, t in zip(raw.doc_id, raw.text) if t and any(c.isalpha() for c in t)}
    want = brute_chunks(list(zip(spoken.doc_id, spoken.text)))
    assert dict(zip(lines.doc_id, lines.text)) == {d: t for d, (_, gone, t) in want.items() if not gone or t.split()}
    assert (lines.n_chars == lines.text.str.len()).all()
    groups = brute_components(list(zip(lines.doc_id, lines.text)), 5, 80)
    assert set(near.doc_id) == {d for d, (_, c) in groups.items() if d == c}
    bench = pd.read_parquet(f"{SMALL}/benchmark.parquet")
    hits = brute_contained(list(zip(near.doc_id, near.text)), list(zip(bench.item_id, bench.text)))
    assert set(clean.doc_id) == set(near.doc_id) - {h[0] for h in hits}
    assert set(coded.doc_id) == set(clean.doc_id) and (coded.n_tokens == coded.ids.map(len)).all()


def test_pipeline_run_and_empty_table(spark, tmp_path):
    whole = corpus_pipeline.run(spark, SMALL)
    assert whole.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and whole.count() > 100
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
