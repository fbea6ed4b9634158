"""Importance resampling against a plain version, with odd rows, ties and hot ids."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import resampling

ODD = [(1, "Apple pie, apple PIE; 3 é " * 9, "x", 1), (2, None, None, None), (3, "", "x", 2), (None, "no id here " * 12, "y", 3), (4, "Apple pie " * 15, "x", 4), (4, "same id, other text " * 8, "x", 5), (5, "word " * 3000, None, 6), (6, " \t\n--", "z", 7), (6, " \t\n--", "z", 7), (7, "ab" * 40, "x", 1), *[(9, "hot row " * 12, "x", 9)] * 40]
SCHEMA = "doc_id long, text string, rank string, segment long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(rows, target, percent=25):
    s, t = np.zeros(10_000, int).tolist(), np.zeros(10_000, int).tolist()
    for texts, into in ((rows, s), (target, t)):
        for _, text in texts:
            for f in features(text)[1]:
                into[zlib.crc32(f.encode()) % 10_000] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000.0) / ((a + 1) * (sum(t) + 10_000.0)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        words, found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, len(words) >= 20 and i is not None])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0], r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(tuple(str(x) for x in r[:5]) for r in out)


@pytest.mark.parametrize("percent", [25, 100])
def test_odd_rows(spark, percent):
    docs, target = spark.createDataFrame(ODD, SCHEMA).repartition(5), spark.createDataFrame([("apple pie",), (None,)], "text string")
    got = resampling.resampled(docs, target, percent).collect()
    assert sorted(tuple(str(x) for x in r) for r in got) == plain([r[:2] for r in ODD], [(0, "apple pie")], percent)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame(ODD[:1], SCHEMA)
    assert resampling.resampled(none, none).columns == ["doc_id", "n_features", "weight", "score", "rank"] and not resampling.resampled(none, one).collect()
    assert [tuple(map(str, r)) for r in resampling.resampled(one, none).collect()] == plain([ODD[0][:2]], [])


def test_features_of_long_texts_in_pieces(monkeypatch):
    text = ("Aa b1 é " * 50 + "x" * 300 + " ") * 3
    monkeypatch.setattr(resampling, "PIECE", 64)
    words, all_features = features(text)
    got = list(resampling.buckets(text.encode()))
    assert len(got) > 5 and sum(n for n, _ in got) == len(words)
    assert sorted(np.concatenate([h for _, h in got]).tolist()) == sorted(zlib.crc32(f.encode()) % 10_000 for f in all_features)


@pytest.mark.parametrize("kinds", [7, 10_000_000])
def test_ranks_are_those_of_a_sort(spark, kinds, monkeypatch):
    monkeypatch.setattr(resampling, "SAMPLES", 8)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") - 1500).alias("doc_id"), F.lit(1).cast("long").alias("n_features"), (F.xxhash64("id") % kinds).alias("score"))
    runs = resampling.stored(rows.repartition(6).withColumn("at", F.monotonically_increasing_id()), "t")
    got, n = resampling.ranked(runs)
    got = sorted((r["rank"], -r.score, r.doc_id) for r in got.collect())
    assert n == 3000 and [g[0] for g in got] == list(range(1, 3001)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
