"""Encoders against the library, Simple-8b against exact round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import DATA
from tests.llm import brute
from triplewright import storage
from triplewright.llm import bpe, token_store

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "a\n\nb", "  x  y ", "İstanbul ΣΑΣ", "<|endoftext|> hi<|startoftext|>x", "tab\there\r\nnew", "don't we'll 's ''s", "é ́x ½²x 12 3", "aaaa aaaaaaa", " nb  x\u0085z\x1cq", "\x02 x \x02", "x\n", "\nx", "‍zero​ w", "word.,!! a.b ...",
    "İ, DEĞERLİ. İ.", "क़. ,क़", "שׁ.x", "².½, Ⅳ.", "a̧. é,", "ﬁ.ſ,ŉ.",
]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


LIBRARY = {path: library(path) for path in (BYTE, WORD)}


@pytest.fixture(scope="module")
def texts():
    return brute.EDGE + ODD + pq.read_table(f"{DATA}/sf0.001/documents.parquet").column("text").to_pylist()


def test_bpe_digest_equals_the_library(spark, texts):
    lib = library(BYTE)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in bpe.bpe_digest(df, BYTE).collect()}
    for i, text in enumerate(texts):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids), (text or "")[:60]
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_round_trip_and_nulls(spark):
    df = spark.createDataFrame([(1, "hello  world"), (1, "hello  world"), (None, None), (2, "")], "doc_id long, text string")
    back = bpe.bpe_decode(bpe.bpe_encode(df, BYTE), BYTE)
    assert sorted((r["text"] for r in back.collect())) == ["", "", "hello  world", "hello  world"]
    assert bpe.bpe_digest(df.limit(0), BYTE).count() == 0


def test_token_files(spark, texts):
    lib = library(WORD)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = token_store.token_file_digest(df, WORD).orderBy("doc_id").collect()
    start = 0
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"]) == (start, len(ids)), (text or "")[:60]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_nulls_ties_and_empty(spark):
    df = spark.createDataFrame([(2, "b"), (None, "z"), (1, "a"), (1, "a")], "doc_id long, text string")
    rows = token_store.token_file_digest(df, WORD).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 1, 2] and [r["start"] for r in rows] == [0, 2, 4, 6]
    assert token_store.token_file_digest(df.limit(0), WORD).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=1500))
def test_simple8b_round_trip(values):
    ids = np.array(values, np.uint64)
    words, blocks = token_store.pack(ids)
    assert (token_store.unpack(words, blocks, len(ids)) == ids).all()
    data, lengths = token_store.read_segment(token_store.segment(ids, np.array([len(ids)])))
    assert (data == ids).all() and lengths.tolist() == [len(ids)]


#: Letters of many scripts, marks that compose and that don't, signs, digits and white space of all kinds.
ALPHABETS = [
    "abcXYZ", "éàüßñçÉÀÜ", "İıIiŞşĞğ", "ſŉŀ", "ЖжяЯ", "ΣσςΑα", "אבשׁוֹ", "قلم", "कख़क़नि", "漢字カナ", "가각", " \n\t\r", "..,,", "!?;:'\"()-_`~@#", "0123²½Ⅳ٣",
    "\u0327\u0301\u0307\u0308\u0344", "ẞÅΩﬁ", "😀👍🏽\u200d", "'s't're've'm'll'd", "Ɪᲀགྷ⫝̸יִ", "\u3000\u00a0\u0085\x1c",
]
MIXED = st.lists(st.one_of(*[st.text(a, min_size=1, max_size=6) for a in ALPHABETS], st.sampled_from(["<|endoftext|>", "İ.", "don't", "word.", "é,", ". ,"])), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(MIXED, min_size=1, max_size=8))
def test_encoders_equal_the_library_on_mixed_alphabets(texts):
    word, byte = token_store.word_encoder(open(WORD).read()), bpe.worker_encoder(open(BYTE).read())
    for path, encode in ((WORD, word), (BYTE, byte.encode)):
        ids, sizes = encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [x.ids for x in LIBRARY[path].encode_batch(texts, add_special_tokens=False)]


def test_very_long_texts_and_clashing_columns(spark):
    texts = ["word, İ. x" * 300_000, "a" * 50_000, "", None]
    df = spark.createDataFrame([(i, t, 7, "p", [1]) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long, payload string, ids array<int>")
    rows = {r["doc_id"]: r for r in token_store.token_file_digest(df, WORD).collect()}
    bytes_ = {r["doc_id"]: r for r in bpe.bpe_digest(df, BYTE).collect()}
    for i, text in enumerate(texts):
        assert rows[i]["n_tokens"] == len(LIBRARY[WORD].encode(text or "", add_special_tokens=False).ids) + 1
        ids = LIBRARY[BYTE].encode(text or "", add_special_tokens=False).ids
        assert bytes_[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert bytes_[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_range_partitions_follow_the_size(spark):
    source = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    assert storage.partitions_for(source) == storage.partitions_for(spark.createDataFrame([(1,)], "a int")) == 4
    assert storage.partitions_for(source.crossJoin(spark.range(100_000))) > 1000
