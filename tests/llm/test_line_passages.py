"""Repeated passages of lines against a search over all pairs of lines, without the operator's hashes or boundaries."""

import random

import pandas as pd
import pytest

import __spark_entry__ as entry
from thermoscope.llm import line_chunks

from .conftest import table

SMALL = "/root/testdata/sf0.001"


def must_go(pairs):
    """{id: lines of passages (two or more lines with words) that also stand at an earlier place}."""
    seen, out = set(), {}
    for i, t in sorted(pairs):
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for a, b in zip(at, at[1:]):
            key = tuple(lines[a:b + 1])
            if key in seen:
                gone |= set(range(a, b + 1))
            seen.add(key)
        out[i] = gone
    return out


def assert_passages(df, pairs):
    """Exactly the repeated lines go, apart from empty lines."""
    got = table(df)
    for (i, t), gone in zip(sorted(pairs), must_go(pairs).values()):
        lines = (t or "").split("\n")
        kept = [x for k, x in enumerate(lines) if k not in gone and x.strip()]
        assert [x for x in got[i]["text"].split("\n") if x.strip()] == kept, i


def test_op8_removes_every_repeated_passage(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    assert_passages(entry.queries()["op8_line_chunks"](spark, SMALL), list(zip(docs.doc_id, docs.text)))


@pytest.mark.parametrize("blank", [0, 1])
def test_planted_passages_go_whole(docs_of, blank):
    """Passages of 2 to 10 lines and over 50 words between unrelated lines of two documents."""
    rng, texts, planted = random.Random(5), [], {}
    line = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    for k in range(90):
        size = 2 + k % 9
        passage = [line(52 // size + 1) for _ in range(size)]
        if blank:
            passage = [y for x in passage for y in (x, "")][:-1]
        for _ in range(2):
            texts.append("\n".join([line(9) for _ in range(rng.randint(1, 6))] + passage
                                   + [line(9) for _ in range(rng.randint(1, 6))]))
        planted[len(texts) - 1] = passage
    got = table(line_chunks.deduplicate(docs_of(texts)))
    for i, text in enumerate(texts):
        if i in planted:
            assert got[i]["n_removed"] == len(planted[i])
            assert not set(x for x in planted[i] if x) & set(got[i]["text"].split("\n"))
        else:
            assert got[i]["text"] == text
