"""Repeated passages of short, long and blankless sentences, planted between unrelated text."""

import random

import pytest

from thermoscope.llm import sentence_spans

from .conftest import table

RNG = random.Random(11)


def words(k):
    return " ".join(f"w{RNG.randrange(10**6)}" for _ in range(k))


def han(k):
    return "".join(chr(RNG.randrange(0x4E00, 0x9FA5)) for _ in range(k))


def removed(docs_of, passage, own):
    """What is left of two documents that share a passage."""
    texts = [own() + passage + own() for _ in range(2)]
    got = table(sentence_spans.deduplicate(docs_of(texts)))
    assert got[0]["text"] == texts[0] and got[0]["n_removed"] == 0
    return texts[1], got[1]


@pytest.mark.parametrize("passage", [
    "\n".join(words(2) for _ in range(30)) + "\n",                       # two-word lines
    " ".join(words(1) + "." for _ in range(60)) + " ",                   # one-word sentences
    words(2) + ". " + words(2) + ". " + words(2) + ". " + words(2) + ". " + words(1) + ". ",
    words(60) + ". ",                                                    # one long sentence
    words(40) + "! " + words(3) + "? ",
])
def test_whole_sentences_go(docs_of, passage):
    text, row = removed(docs_of, passage, lambda: words(12) + ".\n")
    assert row["text"] == text.replace(passage, "")


@pytest.mark.parametrize("passage", ["".join(han(9) + "。" for _ in range(12)), han(70) + "！"])
def test_text_without_blanks(docs_of, passage):
    text, row = removed(docs_of, passage, lambda: han(12) + "。")
    assert row["text"] == text.replace(passage, "")


def test_passage_inside_long_sentences(docs_of):
    """Of 51 to 90 words without a sentence end at most NEAR stay at each end, and nothing else goes."""
    for k in range(51, 90, 3):
        passage = words(k)
        text, row = removed(docs_of, f" {passage} ", lambda: words(45))
        left = [w for w in row["text"].split() if w in passage.split()]
        assert len(left) <= 2 * sentence_spans.NEAR
        assert [w for w in row["text"].split() if w not in passage.split()] == [w for w in text.split() if w not in passage.split()]


def test_unrelated_texts_stay(docs_of):
    texts = [f"{words(70)} in the middle of the night. Yes. No. {words(40)}." for _ in range(20)]
    assert {i: r["text"] for i, r in table(sentence_spans.deduplicate(docs_of(texts))).items()} == dict(enumerate(texts))
