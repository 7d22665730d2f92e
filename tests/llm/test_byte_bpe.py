"""Byte-level BPE against the library that reads rank files, and the round trip of its ids."""

from __future__ import annotations

import hashlib
import random
import struct

import pytest
import public_tokenizers
import tiktoken

from __spark_entry__ import queries
from caseloom.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def numbers(ids: bytes) -> list[int]:
    return [n for n, in struct.iter_unpack("<I", ids)]


def odd_texts() -> list[str]:
    rng = random.Random(5)
    alphabets = ["abcdefgh ", "ab", " \n\t\r", "01234 .", "äöüß éñ", "漢字かな交じり", "😀🎉👩‍👩‍👧", "'s't're've'll", "\x00\x01\x1c\x85\xa0 ​　", "!?#$%"]
    out = ["", " ", "\n", "a", "Hello, world! It's 5 o'clock.", "<|endoftext|>", "<unk><s></s>", "▁lower▁one eighth", "Ġ Ċ", "﻿bom", "é"]
    out += ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(1, 80))) for _ in range(300)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(100)]
    return out + ["x" * 30_000, " " * 30_000 + "x", "7" * 30_000, "漢" * 20_000, "ab" * 20_000, "-" * 30_000]


def test_ids_agree_with_the_library(spark, plain):
    texts = [None, *odd_texts()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, PATH), PATH).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        assert numbers(bytes(row.ids)) == plain.encode_ordinary(text), text[:50]
        assert row.n_tokens == len(row.ids) // 4
        assert bytes(row.decoded) == text.encode()


def test_every_token_keeps_its_id(plain):
    codec = byte_bpe.Codec(*_model(byte_bpe.read_ranks(PATH)))
    for token, rank in byte_bpe.read_ranks(PATH).items():
        assert codec.decode(struct.pack("<I", rank)) == token
    for text in (" hello", "Ä", "\n\n", "   "):
        assert numbers(codec.encode(text.encode())) == plain.encode_ordinary(text)


def _model(ranks):
    import numpy as np

    return byte_bpe.serialised_model(ranks), np.sort(np.fromiter(ranks.values(), "<u4", len(ranks))), public_tokenizers.PATTERN


def test_whole_tokens_and_gaps_between_ranks():
    """A token that no merge reaches still stands for its pre-token, and ranks need not be gapless."""
    ranks = {bytes([b]): 3 * b for b in range(256)} | {b"ab": 1000, b"bc": 900, b"abc": 2000, b"xyz": 5000}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.Codec(*_model(ranks))
    for text in ("abc", "xyz", "xyzz", "abcabc", "aabcc", "abab bcbc", "cba"):
        assert numbers(codec.encode(text.encode())) == plain.encode_ordinary(text)
        assert codec.decode(codec.encode(text.encode())) == text.encode()


def test_vocabularies_without_a_byte_are_refused():
    with pytest.raises(ValueError, match="256 bytes"):
        byte_bpe.serialised_model({b"a": 0})
    with pytest.raises(ValueError, match="distinct"):
        byte_bpe.serialised_model({bytes([b]): 0 for b in range(256)})


def test_forgetting_changes_no_id(monkeypatch, plain):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    monkeypatch.setattr(byte_bpe, "PART", 5)
    codec = byte_bpe.Codec(*_model(byte_bpe.read_ranks(PATH)))
    text = "one two three one two four five one " * 20
    ids = codec.encode(text.encode())
    assert numbers(ids) == plain.encode_ordinary(text) and len(codec.known) <= 3
    assert codec.decode(ids) == text.encode()


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, Ids string, DECODED int")
    out = byte_bpe.decode_documents(byte_bpe.encode_documents(none, PATH), PATH)
    assert out.collect() == [] and out.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    twice = spark.createDataFrame([(None, "same", 1), (None, "same", 1), (7, None, 2)], "doc_id long, text string, n_tokens int")
    rows = byte_bpe.encode_documents(twice, PATH).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 1, 1]
    empty = byte_bpe.decode_documents(spark.createDataFrame([(None,)], "ids binary"), PATH).collect()
    assert bytes(empty[0].decoded) == b""


def test_query_holds_for_whole_documents(spark, plain):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries()["op11_byte_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = plain.encode_ordinary(d.text or "")
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
