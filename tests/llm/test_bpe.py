"""Tree concatenation against the tokenizers library, piece by piece and over tables."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sessionloom.llm import bpe

from ..conftest import DATA

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}
ODD = [(1, "word " * 300, "x", 1), (2, None, None, None), (3, "", "x", 2), (None, "null id " * 90, "y", 3), (4, "ab" * 900, "x", 4), (4, "same id, other text " * 40, "x", 5), (6, " \t\n" * 200, "z", 7), (6, " \t\n" * 200, "z", 7), (7, "tab\tin  a long  \n\n text é ñ I'll 12 " * 30, "z", 7), (8, "é" * 700 + " <|endoftext|> end", "z", 8), *[(9, "hot copies of a text, " * 50, "x", 9)] * 30]
SCHEMA = "doc_id long, text string, key string, ids long"


def digest(path, text):
    ids = LIBRARY[path].encode(text or "", add_special_tokens=False).ids
    decoded = LIBRARY[path].decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4")).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@pytest.fixture(scope="module", params=[BYTES, WORDS])
def encoder(request):
    return request.param, bpe.TreeEncoder(request.param)


LONG = st.one_of(st.text("ab", min_size=1, max_size=300), st.text("aehinrst", min_size=1, max_size=400), st.text("=-#/", min_size=1, max_size=300), st.text("日本語éß", min_size=1, max_size=120), st.lists(st.sampled_from(["the", "tion", "ing", "aaa", "er", "'s", "9"]), min_size=1, max_size=90).map("".join))


@settings(max_examples=150, deadline=None)
@given(text=LONG, size=st.integers(1, 24), window=st.integers(1, 4))
def test_halves_are_the_whole(encoder, text, size, window):
    path, enc = encoder
    held = bpe.PIECE, bpe.WINDOW
    bpe.PIECE, bpe.WINDOW = size, window
    try:
        assert enc.halves
        for piece in enc._pretokens(text):
            assert enc.tree(piece) == enc.merged(piece)
    finally:
        bpe.PIECE, bpe.WINDOW = held


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.sampled_from("ab eI'l1\n\t é́-日  "), min_size=2, max_size=160), cut=st.integers(1, 159), words=st.integers(1, 3))
def test_joins_of_texts(encoder, text, cut, words):
    path, enc = encoder
    a, b = text[:cut], text[cut:]
    held, bpe.WORDS = bpe.WORDS, words
    try:
        got = enc.joined((a, enc.encode([a])[0]), (b, enc.encode([b])[0]))
    finally:
        bpe.WORDS = held
    assert got[0] == text and np.frombuffer(got[1], enc.dtype).tolist() == LIBRARY[path].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("leaf", [64, 32_768])
def test_odd_rows(spark, path, leaf):
    got = bpe.coded(spark.createDataFrame(ODD, SCHEMA).repartition(3), path, leaf=leaf).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *digest(path, t))) for i, t, *_ in ODD)


def test_empty_table(spark):
    got = bpe.coded(spark.createDataFrame([], SCHEMA), WORDS)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and not got.collect()


def test_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, bpe.op13_bpe(spark, DATA).collect()))) == sorted(str((i, *digest(WORDS, t))) for i, t in rows)
