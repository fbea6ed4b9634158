"""Repeated windows against brute force: window lengths, large and null ids, other columns, suffix structures."""

import datetime
import hashlib

import numpy as np
import pytest

from sessionloom.llm import common, earlier_copies, superkmers

BIG = 1 << 53


def texts_of(seed, n=30, unit=60, words=50):
    rng = np.random.default_rng(seed)
    known = [f"w{i}" for i in range(words)]
    shared = [" ".join(rng.choice(known, unit)) for _ in range(3)]
    return [" ".join([*rng.choice(known, int(rng.integers(0, 40))), shared[i % 3], *rng.choice(known, int(rng.integers(0, 40)))]) for i in range(n)]


def words_gone(texts, k):
    """By document, the words covered by a window of k words that starts elsewhere too."""
    seen = {}
    for d, t in enumerate(texts):
        w = (t or "").split()
        for i in range(len(w) - k + 1):
            seen.setdefault(tuple(w[i : i + k]), []).append((d, i))
    gone = [set() for _ in texts]
    for at in seen.values():
        for d, i in at if len(at) > 1 else ():
            gone[d] |= set(range(i, i + k))
    return gone


def bytes_gone(ids, texts, k):
    """By document, the bytes covered by a string of k bytes that starts in a document with a smaller id too."""
    seen = {}
    for d, t in zip(ids, texts, strict=True):
        raw = (t or "").encode()
        for i in range(len(raw) - k + 1):
            s = raw[i : i + k]
            seen[s] = min(seen.get(s, d), d, key=lambda x: (x is not None, x or 0))
    gone = []
    for d, t in zip(ids, texts, strict=True):
        raw, out = (t or "").encode(), set()
        for i in range(len(raw) - k + 1):
            first = seen[raw[i : i + k]]
            if d is not None and (first is None or first < d):
                out |= set(range(i, i + k))
        gone.append(out)
    return gone


@pytest.mark.parametrize("k", [8, 35, 50, 100, 200])
def test_window_lengths(spark, k):
    texts = texts_of(k, 12, 300, 9)
    texts[3] = texts[4] = "a b a b " * 150
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in superkmers.substring_dedup(df, k).collect()} == {d: len(g) for d, g in enumerate(words_gone(texts, k))}
    assert {r.doc_id: r.n_removed for r in earlier_copies.suffix_dedup(df, k).collect()} == {d: len(g) for d, g in enumerate(bytes_gone(range(12), texts, k))}


def test_short_windows_and_wrong_pieces(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in superkmers.substring_dedup(df, 1).collect()} == {1: 3, 2: 1, 3: 0}
    with pytest.raises(ValueError, match="don't fit"):
        superkmers.super_kmers(np.zeros(50, np.uint64), np.array([0, 50]), 5, 6)


def test_no_super_kmer_is_longer_than_its_marks():
    units = np.arange(5000, dtype=np.uint64)
    first, size, _ = superkmers.super_kmers(units, np.array([0, 2000, 5000]), 200, 9)
    assert size.max() == superkmers.MOST and size.sum() == 1801 + 2801
    assert np.concatenate([np.arange(a, a + n) for a, n in zip(first, size, strict=True)]).tolist() == [*range(1801), *range(2000, 4801)]


@pytest.mark.parametrize("hot", [2, 10**9])
@pytest.mark.parametrize("part", [200, 1 << 23])
def test_hot_minimisers_and_parts_change_nothing(spark, monkeypatch, hot, part):
    monkeypatch.setattr(superkmers, "HOT", hot)
    monkeypatch.setattr(superkmers, "PART_BYTES", part)
    texts = texts_of(5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in superkmers.substring_dedup(df).collect()} == {d: len(g) for d, g in enumerate(words_gone(texts, 35))}
    got = {r.doc_id: bytes(r.kept) for r in earlier_copies.suffix_dedup(df).collect()}
    assert got == {d: bytes(b for i, b in enumerate(texts[d].encode()) if i not in g) for d, g in enumerate(bytes_gone(range(30), texts, 50))}


def test_large_and_null_ids_stay_exact(spark):
    texts = [*texts_of(6), None, "", "x"]
    ids = [None if i % 5 == 0 else BIG + 1 + i for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    known = lambda rows: sorted(rows, key=str)
    want = [(d, len(g)) for d, g in zip(ids, words_gone(texts, 35), strict=True)]
    assert known((r.doc_id, r.n_removed) for r in superkmers.substring_dedup(df).collect()) == known(want)
    want = [(d, len(g)) for d, g in zip(ids, bytes_gone(ids, texts, 50), strict=True)]
    assert known((r.doc_id, r.n_removed) for r in earlier_copies.suffix_dedup(df).collect()) == known(want)


def test_other_columns_come_back_as_they_were(spark):
    texts = texts_of(7, 20)
    at = datetime.datetime(2024, 1, 2, 3, 4, 5)
    rows = [(BIG + 1 + i, None if i % 4 == 0 else BIG + i, t, [i, None], {"a": i} if i % 3 else None, at, f"g{i}", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, other_0 long, text string, block array<int>, `a.b` map<string,int>, stamp timestamp, gone string, n_chars int")
    left = superkmers.without_repeats(df)
    assert left.columns == df.columns and left.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    gone, want = words_gone(texts, 35), {}
    for i, r in enumerate(rows):
        kept = " ".join(w for j, w in enumerate(texts[i].split()) if j not in gone[i]) if gone[i] else texts[i]
        if kept or not gone[i]:
            want[r[0]] = (*r[:2], kept, *r[3:7], len(kept))
    assert {r.doc_id: tuple(r) for r in left.collect()} == want and len(want) > 10


def test_rows_repeated_very_often(spark):
    df = spark.createDataFrame([(7, "some words that come again " * 20)], "doc_id long, text string").crossJoin(spark.range(500)).drop("id").repartition(4)
    got = superkmers.substring_dedup(df).groupBy("doc_id", "n_removed").count().collect()
    assert [tuple(r) for r in got] == [(7, 100, 500)]
    assert [tuple(r) for r in earlier_copies.suffix_dedup(df).groupBy("doc_id", "n_removed").count().collect()] == [(7, 0, 500)]


def test_packed_rows_stay_in_proportion():
    for total in (0, 10, 10**6, 10**9, 10**12, 10**14):
        for parallel in (1, 8, 1000, 100_000):
            assert superkmers.sides(total, parallel) ** 2 <= max(1, total / superkmers.ROW_BYTES)
    assert superkmers.sides(10**9, 8) == 120


def common_prefix(a, b):
    n = 0
    while n < len(a) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(20))
def test_longest_previous_factors(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 60)), int(rng.integers(1, 12))
    text, docs = rng.integers(0, int(rng.integers(1, 4)), n + k - 1).astype(np.uint8), rng.integers(0, 5, n)
    order, shared = earlier_copies.suffix_array(text, np.arange(n), k)
    suffixes, docs = [text[i : i + k].tobytes() for i in order], docs[order]
    assert suffixes == sorted(suffixes) and all(shared[i] == common_prefix(suffixes[i - 1], suffixes[i]) for i in range(1, n))
    want = np.array([max([common_prefix(suffixes[i], suffixes[j]) for j in range(n) if docs[j] < docs[i]], default=0) for i in range(n)])
    assert (earlier_copies.longest_previous(docs, shared) == want).all()
    assert ((earlier_copies.longest_previous(docs, shared, k) >= k) == (want >= k)).all()


def test_no_suffix_at_all():
    assert len(earlier_copies.longest_previous(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_digests(spark):
    docs = spark.createDataFrame([(1, "é " * 40), (2, "é " * 40), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in earlier_copies.suffix_dedup(docs, result=earlier_copies.byte_rows, schema=earlier_copies.BYTE_ROWS).collect()}
    assert got[2].n_removed == 120 and got[2].n_spans == 1 and got[1].n_removed == 0 and got[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    words = superkmers.word_dedup(common.pick(docs, doc_id="doc_id", text="text"), superkmers.word_rows, superkmers.WORD_ROWS)
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in words.collect()} == {(d, n, n, hashlib.sha256(b"").hexdigest()) for d, n in ((1, 40), (2, 40), (3, 0))}


@pytest.mark.parametrize(("count", "parts"), [(1, 1), (1, 7), (5, 4), (100, 51), (40, 211)])
def test_keys_are_dealt_evenly(spark, count, parts):
    keys = common.even_keys(spark, count, parts)
    df = spark.createDataFrame([(k,) for k in keys.tolist()], "block long").repartition(parts, "block")
    sizes = [len(p) for p in df.rdd.glom().collect()]
    assert len(set(keys.tolist())) == count and sum(sizes) == count and max(sizes) == -(-count // parts)
