"""Token files and the piece codec against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from thermoscope.llm import piece_codec, token_files

from .conftest import table

ODD = [None, "", " ", "\n", "  two  blanks ", "áb  ́c <|endoftext|>x y<|endoftext|>\n\nİΣς don't it's \x1c x y\t　z\x00 ｆｕｌｌ",
       "ﬁ 가각\r\nẛ̣  q", "ΑΣ ΑΣ. ΣΑΣ", "J̌ <|EndOfText|> A,́b", "Hello▁world ▁▁ x\x01y", "🤗🤗 日本語 <s> <0x0A>",
       " " * 300 + "x" + " " * 37, "ab" * 4000, "a" * 3000, "word, word; word! (word) [x]"]


@pytest.mark.parametrize("n", [0, 1, 59, 4096, 4097, 9000])
@pytest.mark.parametrize("top", [1, 2, 50, 49408, 2**33, 2**63])
def test_simple8b_round_trip(n, top):
    rng = np.random.default_rng(n + top % 97)
    ids = rng.integers(0, top, n, dtype=np.uint64)
    ids[rng.random(n) < 0.3] //= np.uint64(max(1, top // 3))
    if n and top == 2**63:
        ids[::7] = 2**64 - 1   # escaped
    words, offsets = token_files.pack(ids)
    assert np.array_equal(token_files.unpack(words, offsets, n), ids)


def test_block_format_round_trip():
    docs, lens = np.array([3, 5, 9]), np.array([2, 1, 3])
    ids = np.array([7, 2, 2, 70000, 1, 2], np.uint64)
    data = token_files.write_block(docs, lens, ids) + b"\n" + token_files.write_block(docs, lens, ids) + b"\n"
    got = list(token_files.read_blocks(data))
    assert len(got) == 2
    for d, n, i in got:
        assert d.tolist() == [3, 5, 9] and n.tolist() == [2, 1, 3] and i.tolist() == ids.tolist()


def test_word_encoder_equals_library(proto, documents):
    enc = token_files.WordEncoder(proto("word_bpe_49k.json"))
    texts = ODD + documents.text.tolist()
    n, flat = enc.encode(pa.array(texts))
    want = [e.ids for e in enc.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert n.tolist() == list(map(len, want))
    assert flat.tolist() == [i for x in want for i in x]


def test_op3_query(spark, proto, documents):
    got = table(entry.queries()["op3_token_files"](spark, "/root/testdata/sf0.001"))
    from tokenizers import Tokenizer
    tok, start = Tokenizer.from_buffer(proto("word_bpe_49k.json")), 0
    for d, text in sorted(zip(documents.doc_id, documents.text)):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        r = got.pop(d)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_token_files_edges(docs_of, proto):
    model = proto("word_bpe_49k.json")
    got = table(token_files.round_trip(docs_of([None, "", "a b", "a b"]), model))
    assert [got[i]["n_tokens"] for i in range(4)] == [1, 1, 3, 3]
    assert [got[i]["start"] for i in range(4)] == [0, 1, 2, 5]
    assert token_files.round_trip(docs_of([]), model).count() == 0
    assert token_files.round_trip(docs_of([(1, "a"), (1, "a"), (0, "b")]), model).count() == 3
    with pytest.raises(ValueError):
        token_files.round_trip(docs_of([(None, "a")]), model)


def test_prefix_table_equals_library(proto, documents):
    model = piece_codec.PieceModel(proto("piece_bpe_32k.model"))
    rng = random.Random(5)
    texts = ODD + documents.text.tolist() + [
        "".join(rng.choice("aeiothns ▁\né,.  ABC12") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    n, flat = model.encode(pa.array(texts))
    want = model.sp.encode([x or "" for x in texts])
    assert n.tolist() == list(map(len, want))
    assert flat.tolist() == [i for x in want for i in x]


def test_unique_last_piece(proto):
    """Every prefix of a word has one last piece: the table agrees with encoding each prefix apart."""
    model = piece_codec.PieceModel(proto("piece_bpe_32k.model"))
    for word in ("▁internationalization", "▁thereareinthe", "▁señoritas"):
        for k in range(1, len(word) + 1):
            assert model.encode_segment(word[:k]) == [model.id_of[p] for p in model.merge(word[:k])]


def test_op9_query(spark, proto, documents):
    got = table(entry.queries()["op9_piece_codec"](spark, "/root/testdata/sf0.001"))
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto("piece_bpe_32k.model"))
    for d, text in zip(documents.doc_id, documents.text):
        ids = sp.encode(text or "") + [sp.eos_id()]
        r = got.pop(d)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert not got


def test_piece_codec_edges(docs_of, proto):
    model = proto("piece_bpe_32k.model")
    got = table(piece_codec.encode_texts(docs_of([None, "", "a b", (2, "a b"), (None, "x")]), model))
    assert got[0]["ids"] == [2] and got[0]["decoded"] == "" and got[1]["ids"] == [2]
    assert got[None]["decoded"] == "x" and got[2]["decoded"] == "a b"
    assert piece_codec.encode_texts(docs_of([]), model).count() == 0


def test_ids_become_lists_at_once():
    """Equal to Arrow's lists, in a fraction of the time that its conversion one by one takes (op9 used it)."""
    import time
    n = np.array([0, 3, 0, 400_000, 1])
    flat, bounds = np.arange(n.sum(), dtype=np.int32), np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    began = time.process_time()
    want = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)).to_pylist()
    middle = time.process_time()
    assert piece_codec._lists(flat, bounds) == want
    assert time.process_time() - middle < 0.5 * (middle - began)
