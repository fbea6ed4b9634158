"""The pipeline's stages, each against brute force on its own input, and on odd and empty documents."""

import warnings
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sessionloom.llm import common, mixing, quality

from ..conftest import DATA
from .test_near_copies import similarities
from .test_operators import components, pieces_fit
from .test_windows import words_gone


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_each_stage_against_brute_force(spark):
    docs, labels = common.read(spark, DATA, "documents"), common.read(spark, DATA, "labels")
    columns, kept = docs.columns, {}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, common.stored(stage(spark, docs, DATA), "test")
            kept[name] = (before, rows_of(before), docs)
            assert name == "packing" or docs.columns == columns
        before, was, after = kept["mixing"]
        rates = {r.doc_id: r for r in mixing.mixed(before, labels, mixing.WITHOUT_LOW).collect()}
    assert rows_of(after) == {d: r for d, r in was.items() if rates[d].copies > 0 or rates[d].home_rate >= 1}

    before, was, after = kept["quality"]
    good = {r.doc_id for r in quality.quality_scores(before, labels).collect() if r.score >= 0.3}
    assert rows_of(after) == {d: r for d, r in was.items() if d in good} and len(good) < len(was)

    before, was, after = kept["near_duplicates"]
    ids = sorted(was)
    first = components(similarities([was[d].text for d in ids]) >= 0.8)
    assert rows_of(after) == {d: was[d] for d, c in zip(ids, first, strict=True) if ids[c] == d}

    before, was, after = kept["substrings"]
    ids, left = sorted(was), rows_of(after)
    for d, gone in zip(ids, words_gone([was[d].text for d in ids], 35), strict=True):
        words = was[d].text.split()
        text = " ".join(w for i, w in enumerate(words) if i not in gone) if gone else was[d].text
        assert (left[d].text, left[d].n_chars) == (text, len(text) if gone else was[d].n_chars) if text or not gone else d not in left

    before, was, after = kept["packing"]
    pieces = after.toPandas()
    pieces_fit(pieces, 4096)
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array([*whole.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for d, r in was.items()}
    assert set(pieces.doc_id) == set(ids) and all(zlib.crc32(ids[p.doc_id][p.start : p.start + p.length]) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id]) for p in pieces.itertuples())


def test_odd_and_empty_documents(spark):
    texts = [r.text for r in common.read(spark, DATA, "documents").orderBy("doc_id").limit(30).collect()]
    big = (1 << 53) + 1
    rows = [(big + i, t, "en", "src0", len(t), None if i % 3 else big + i, [i, None]) for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None, None, None), (big + 1, None, None, None, 0, 7, []), (3, "", "de", "x", 0, big + 2, [1]), (4, " \t\n", None, None, None, None, None), (5, "word " * 30_000, "en", "y", 1, 1, None), (5, "word " * 30_000, "en", "y", 1, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, gone long, left_out array<int>")
    for c in ("other_0", "block", "copies", "node", "print", "range"):
        docs = docs.withColumn(c, docs.gone)
    columns, values = docs.columns, {(r.doc_id, r.gone, str(r.left_out)) for r in docs.collect()}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        none = docs.where("false")
        for name, stage in corpus_pipeline.STAGES:
            docs, none = common.stored(stage(spark, docs, DATA), "odd"), stage(spark, none, DATA)
            assert none.count() == 0
            if name != "packing":
                assert docs.columns == columns and {(r.doc_id, r.gone, str(r.left_out)) for r in docs.collect()} <= values and docs.count() > 10
                none = docs.where("false")
    ids = {r.doc_id for r in docs.collect()}
    assert len(ids) > 10 and all(i is None or i > big - 1 or i < 10 for i in ids)
