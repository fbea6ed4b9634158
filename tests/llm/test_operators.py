"""The corpus operators against brute force, round trips and held-out accuracy, with odd inputs."""

import glob
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sessionloom.llm import common, earlier_copies, encoding, fingerprints, packing, registry, superkmers, token_files, url_rules

from ..conftest import DATA

ODD = [(1, "a b c " * 60, "x", 1), (2, None, None, None), (3, "", "x", 2), (None, "null id", "y", 3), (4, "a b c " * 60, "x", 4), (4, "same id other text", "x", 5), (5, "word " * 30_000, None, 6), (6, " \t\n", "z", 7), (6, " \t\n", "z", 7)]
SCHEMA = "doc_id long, text string, block string, n long"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").df()


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or v is pd.NA or v != v else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {p.rpartition('/')[2][:-8]} AS SELECT * FROM '{p}'")
    assert rows_of(registry.QUERIES[name](spark, DATA).toPandas()) == rows_of(c.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_is_the_library(path, docs):
    texts = [*docs.text[:60], "", "it's  <|endoftext|> x", "tab\t x", "İĞ ŉ ſ ²3 日本語 é", "\n\n a  b\n", "x" * 500]
    enc, whole = encoding.WordEncoder(path), Tokenizer.from_file(path)
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, enc.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_new_words_reach_the_merges_together(path):
    """op4_packing: a call of the library for each new word took most of its CPU seconds."""

    class Counted:
        def __init__(self, inner):
            self.inner, self.calls = inner, 0

        def __getattr__(self, name):
            self.calls += 1
            return getattr(self.inner, name)

    enc, whole = encoding.WordEncoder(path), Tokenizer.from_file(path)
    enc.model, enc.tokenizer, enc.merges = counted = [Counted(x) for x in (enc.model, enc.tokenizer, getattr(enc, "merges", None))]
    texts = [" ".join(np.base_repr(n * n + 31 * k, 36).translate(str.maketrans("0123456789", "éàtionrEst")) + "," for n in range(600, 900)) for k in range(20)]
    assert [np.frombuffer(i, enc.dtype).tolist() for i in enc.encode(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert sum(c.calls for c in counted) < 10


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_of_mixed_words(path):
    """Plain words, others and the mark between words in one call, in many calls, and with a memory for few pieces."""
    rng, whole = np.random.default_rng(3), Tokenizer.from_file(path)
    parts = ["a", "É", " ", " ", "\n", "'s", "'", "12", ".", "!!", "<|", "<|endoftext|>", "\t", "\u2003", "\x85", "\u0301", "日", "\0", "ſ", "İ", "word", "x" * 30, "  ", "²"]
    texts = ["", "\0", " ", "\n\n", "  a  ", "end  ", *["".join(rng.choice(parts[:k], rng.integers(0, 30))) for k in (9, 10, len(parts)) for _ in range(400)]]
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    for limit, size in ((700_000, len(texts)), (40, 50), (700_000, 1)):
        enc = encoding.WordEncoder(path, limit)
        got = [i for a in range(0, len(texts), size) for i in enc.encode(texts[a : a + size])]
        assert [np.frombuffer(i, enc.dtype).tolist() for i in got] == want
        assert enc.fits and not enc.encode([])


def test_slices_hold_few_bytes():
    import pyarrow as pa

    texts = ["é" * 10, None, "", "a" * 50, "b", "c", "d" * 9]
    got = list(encoding.slices(pa.array(["left out", *texts]).slice(1), 3, 20))
    assert got == [["é" * 10, "", ""], ["a" * 50], ["b", "c", "d" * 9]]


@pytest.mark.parametrize("bits", [1, 7, 16, 17])
def test_token_file_round_trip(bits):
    rng = np.random.default_rng(bits)
    lengths = np.array([0, 5, 40_000, 1])
    ids = rng.integers(0, 1 << bits, lengths.sum())
    f = token_files.TokenFile(token_files.to_file([7, None, 9, -1], lengths, ids, bits))
    assert f.doc_ids == [7, None, 9, -1] and (f.ids(0, f.n) == ids).all() and (f.document(2) == ids[5:40_005]).all() and (f.ids(16_380, 16_390) == ids[16_380:16_390]).all()


def test_token_files(spark, docs):
    got = token_files.op1_token_files(spark, DATA).toPandas().sort_values("doc_id")
    whole, at = Tokenizer.from_file(BYTES), 0
    for d, text, start, n, crc in zip(docs.doc_id, docs.text, got.start, got.n_tokens, got.ids_crc32, strict=True):
        ids = [*whole.encode(text, add_special_tokens=False).ids, 0]
        assert (start, n, crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4"))), d
        at += len(ids)


def test_url_rules(spark):
    urls = ["HTTP://A.Net/x", "http://example.net/en/1", "http://anet/x", "http://a.net", "no url", None, "x://example.com/de/?q#f", "a://b.ORG/fr/é?x", "http://notexample.com/de/", "x://" + "a." * 5000 + "net/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = [(r.host[-12:], r.path, r.rule, r.verdict) for r in url_rules.url_verdicts(df).orderBy("page_id").collect()]
    assert got[:8] == [("a.net", "/x", "net/", "block"), ("example.net", "/en/1", "example.net/en/", "allow"), ("anet", "/x", None, "allow"), ("a.net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("b.org", "/fr/é", "org/fr/", "allow")]
    assert got[8][2:] == (None, "allow") and got[9][2:] == ("net/", "block")
    many = url_rules.ShiftAnd([f"h{i}?/*x" for i in range(40)])
    assert many.matches([b"h7a/bbx", b"h39z/x", b"h7a/y"]).nonzero()[1].tolist() == [7, 39]


def test_url_rules_fit_hosts_not_paths(spark):
    urls = ["http://archive.org/web/www.site.net/x", "http://a.com/r/x.org/fr/y", "http://a.com/.net/", "http://b.net/x.org/fr/", "http://a.com/.example.com/de/1", "http://x.org/fr/a.net/", "http://a.com//.net/", "http://.net/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    c = duckdb.connect()
    c.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    got = url_rules.url_verdicts(df).toPandas()
    assert rows_of(got) == rows_of(c.sql(url_rules.OP2_SQL).df())
    assert got.sort_values("page_id").rule.where(got.rule.notna(), None).tolist() == [None, None, None, "net/", None, "org/fr/", None, "net/"]


def verdict(url):
    """host, path, rule and verdict of a URL, rule by rule."""
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", "", None, "allow"
    rest = url[at + 3 :]
    end = min([len(rest), *[i for i in map(rest.find, "/?#") if i >= 0]])
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = path[: min([len(path), *[i for i in map(path.find, "?#") if i >= 0]])]
    best = None
    for rule, says in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")):
        name, slash, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + start) and (best is None or len(rule) > len(best[0])):
            best = rule, says
    return host, path, *(best or (None, "allow"))


def test_url_rules_on_random_urls(spark, none):
    rng = np.random.default_rng(7)
    parts = ["http", "://", ".", "/", "net", "example", "com", "org", "de", "fr", "en", "A", "?", "#", "x", "É", "\n", "NET", "www"]
    urls = ["".join(rng.choice(parts, int(rng.integers(0, 14)))) for _ in range(1500)] + ["a://" + "".join(rng.choice(parts[2:], int(rng.integers(1, 12)))) for _ in range(1500)]
    urls += [None, "", "://", "x://net/", "x://.net/", "x://a/" + ".net/" * 4000, "x://" + "b." * 3000 + "net/" + "y/" * 3000]
    rows = [(i % 900, u, "r", "v") for i, u in enumerate(urls)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, host string").withColumn("which", url_rules.F.lit(1))
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.url_verdicts(df).collect()), key=str)
    assert got == sorted(((i, *verdict(u)) for i, u, *_ in rows), key=str)
    assert url_rules.url_verdicts(none.selectExpr("doc_id AS page_id", "text AS url")).count() == 0
    c = duckdb.connect()
    c.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls[:3000])))
    own = url_rules.url_verdicts(spark.createDataFrame(list(enumerate(urls[:3000])), "page_id long, url string")).toPandas()
    assert rows_of(own) == rows_of(c.sql(url_rules.OP2_SQL).df())


def test_token_files_of_odd_rows(spark, odd, none):
    whole, at = Tokenizer.from_file(BYTES), 0
    df = odd.withColumns({"file": odd.n, "at": odd.n, "ids": odd.block})
    path = common.scratch(spark, "odd-tokens")
    got = token_files.read_token_files(spark, path, token_files.write_token_files(df, path, BYTES, 0)).collect()
    want = []
    for d, text in sorted(((d, t or "") for d, t, *_ in ODD), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*whole.encode(text, add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    path = common.scratch(spark, "no-tokens")
    assert token_files.write_token_files(none, path, BYTES, 0).count() == 0


def test_packing_of_odd_rows(spark, odd):
    whole = Tokenizer.from_file(WORDS)
    ids = [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t, *_ in ODD]
    df = odd.withColumns({"part": odd.n, "tail": odd.n, "rank": odd.block})
    pieces = packing.pack_documents(df, WORDS, 2).collect()
    assert sum(p.length for p in pieces) == sum(map(len, ids))
    firsts = sorted((str(p.doc_id), p.doc_tokens) for p in pieces if p.start == 0)
    assert firsts == sorted((str(d), len(i)) for (d, *_), i in zip(ODD, ids, strict=True))
    texts = {(str(d), len(i)): i for (d, *_), i in zip(ODD, ids, strict=True)}
    assert all(zlib.crc32(texts[str(p.doc_id), p.doc_tokens][p.start : p.start + p.length]) == p.ids_crc32 for p in pieces)


def pieces_fit(pieces, window):
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.cumsum(s.length) - s.length).all() and s.length.sum() <= window
    for _, d in pieces.groupby("doc_id"):
        d = d.sort_values("start")
        assert d.length.sum() == d.doc_tokens.iloc[0] and (d.start.to_numpy() == np.cumsum(d.length) - d.length).all()


def test_packing(spark, docs, odd, none):
    pieces = packing.op4_packing(spark, DATA).toPandas()
    pieces_fit(pieces, 4096)
    whole = Tokenizer.from_file(WORDS)
    ids = {d: np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4") for d, t in zip(docs.doc_id, docs.text, strict=True)}
    assert all(zlib.crc32(ids[p.doc_id][p.start : p.start + p.length]) == p.ids_crc32 for p in pieces.itertuples())
    fill = pieces.groupby("sequence_id").length.sum()
    assert all(n == 4096 or n & (n - 1) == 0 for n in fill)
    assert packing.pack_documents(odd, WORDS, 2).toPandas().length.sum() == packing.pack_documents(odd, WORDS, 2).select("doc_id", "doc_tokens", "start").where("start = 0").toPandas().doc_tokens.sum()
    assert packing.pack_documents(none, WORDS, 2).count() == 0


def test_packing_holds_no_words_after_encoding(spark, docs):
    """Workers stay: what they remember of words took hundreds of MB beside the placing of pieces."""
    pieces = packing.pack_documents(spark.createDataFrame([(1, "some words")] * 50, "doc_id long, text string"), WORDS, 2)

    def held(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encoding._encoders)] * batch.num_rows)], ["n"])

    assert {r.n for r in pieces.mapInArrow(held, "n long").collect()} == {0}


def components(linked):
    comp = np.arange(len(linked))
    while True:
        new = np.array([comp[row].min() for row in linked])
        if (new == comp).all():
            return comp
        comp = new


def test_simhash(spark, docs, odd, none, monkeypatch):
    monkeypatch.setattr(fingerprints, "LEAF", 16)
    got = fingerprints.op5_simhash(spark, DATA).toPandas().sort_values("doc_id")
    prints = np.array([fingerprints.simhash(fingerprints.shingle_hashes(t, 3)) for t in docs.text], np.uint64)
    assert [f"{int(p):016x}" for p in prints] == got.fingerprint.tolist()
    near = components(np.bitwise_count(prints[:, None] ^ prints) <= 3)
    assert docs.doc_id.to_numpy()[near].tolist() == got.component_id.tolist()
    assert fingerprints.near_duplicates(odd).count() == len(ODD) and fingerprints.near_duplicates(none).count() == 0


def test_vantage_tree_parts_no_near_pair():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 32, 400, dtype=np.uint64)
    x = np.concatenate([x, x ^ np.uint64(1 << 9)])
    tree = fingerprints.VantageTree(x, 6)
    at, leaf = tree.shards(x)
    shards = [set(leaf[at == i]) for i in range(len(x))]
    assert tree.leaves > 16 and all(shards[i] & shards[i + 400] for i in range(400))


def test_first_of_groups(spark, odd, none):
    text = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(1, text), (2, text.replace("w150", "zz")), (3, text), (4, "other words " * 20), (None, text)], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in fingerprints.first_of_groups(df).collect()) == ["1", "4", "None"]
    assert fingerprints.first_of_groups(none).count() == 0 and fingerprints.first_of_groups(odd).columns == odd.columns


def test_substrings_on_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.n_words, r.n_removed) for r in superkmers.substring_dedup(odd).collect()}
    assert (1, 180, 180) in got and (4, 180, 180) in got and (2, 0, 0) in got and (None, 2, 0) in got and (5, 30_000, 30_000) in got
    assert superkmers.substring_dedup(none).count() == 0
    left = {r.doc_id: r.text for r in superkmers.without_repeats(odd).collect()}
    assert left[None] == "null id" and 1 not in left and left[2] is None


def test_suffixes_on_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in earlier_copies.suffix_dedup(odd).collect()}
    assert (1, 360, 0) in got and (4, 360, 360) in got and (2, 0, 0) in got and (5, 150_000, 0) in got
    assert earlier_copies.suffix_dedup(none).count() == 0
