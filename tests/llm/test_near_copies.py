"""Vantage-point trees and near copies against brute force, with growing and hot inputs."""

import numpy as np
import pytest

from sessionloom.llm import fingerprints

from .test_operators import components


def near_texts(seed, pairs=80):
    """Random texts and edits of them, some with one passage in common, of similarities from 0.5 to 1."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    texts, boilerplate = [], " ".join(rng.choice(words, 40))
    for k in range(pairs):
        base = rng.choice(words, int(rng.integers(8, 250))).tolist()
        new = [*base, *rng.choice(words, int(len(base) * rng.uniform(0.05, 0.4)))] if k % 2 else base[int(len(base) * rng.uniform(0, 0.3)) :]
        texts += [" ".join([*t, boilerplate] if k % 4 == 0 else t) for t in (base, new)]
    return texts


def similarities(texts):
    sets = [set(fingerprints.shingle_hashes(t, 5).tolist()) for t in texts]
    return np.array([[1.0 if a == b else len(a & b) / len(a | b) for b in sets] for a in sets])


@pytest.mark.parametrize(("points", "share", "seed"), [(8192, 1 << 20, 8), (8, 3000, 9)])
def test_near_copies_by_exact_similarity(spark, monkeypatch, points, share, seed):
    monkeypatch.setattr(fingerprints, "POINTS", points)
    monkeypatch.setattr(fingerprints, "SHARE", share)
    texts = near_texts(seed)
    alike = similarities(texts)
    assert ((alike > 0.7) & (alike < 0.8)).sum() > 20 and ((alike >= 0.8) & (alike < 0.9)).sum() > 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in fingerprints.first_of_groups(df).collect()} == set(components(alike >= 0.8).tolist())


@pytest.mark.parametrize(("points", "share"), [(8192, 1 << 20), (16, 6000)])
def test_a_hot_group_of_near_copies(spark, monkeypatch, points, share):
    monkeypatch.setattr(fingerprints, "POINTS", points)
    monkeypatch.setattr(fingerprints, "SHARE", share)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    texts = []
    base = rng.choice(words, 120)
    for k in range(240):  # three families about one text, so that shards hold several components
        new = base.copy()
        new[40 * (k % 3) : 40 * (k % 3) + 6] = f"family{k % 3}"
        new[int(rng.integers(0, 120))] = f"own{k}"
        texts.append(" ".join(new))
    alike = similarities(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in fingerprints.first_of_groups(df).collect()} == set(components(alike >= 0.8).tolist())


def test_tasks_join_all_members_of_different_components(spark):
    rng = np.random.default_rng(1)
    rows = [(b, i, min(i % (b + 1), 1 + i % 2) if b < 3 else 5, int(rng.integers(1, 9))) for b in range(4) for i in range(40)]
    df = spark.createDataFrame(rows, "block long, id long, comp long, load long")
    for share in (1000, 20):
        met = {}
        for r in fingerprints.in_tasks(df, share).collect():
            met.setdefault((r.block, r.i, r.j, r.mixed), []).append((r.id, r.comp))
        pairs = {(k[0], a[0], b[0]) for k, v in met.items() for a in v for b in v if a[1] != b[1]}
        assert pairs == {(x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[2] != y[2]}


def test_reach_and_bands_miss_next_to_nothing():
    rng = np.random.default_rng(2)
    reach, missed, apart = fingerprints.reach_for(0.8), 0, 0
    for n in (20, 60, 300):
        for _ in range(120):
            common, own = rng.integers(0, 1 << 63, round(0.8 * n), dtype=np.uint64), rng.integers(0, 1 << 63, 2 * (n - round(0.8 * n)), dtype=np.uint64)
            a, b = np.concatenate([common, own[::2]]), np.concatenate([common, own[1::2]])
            a, b = (a, b) if len(common) / (len(common) + len(own)) >= 0.8 else (np.append(common, own[: len(common) // 4]), common)
            prints = [np.array([fingerprints.simhash(fingerprints.mix64(x + np.uint64(k))) for k in range(4)], np.uint64) for x in (a, b)]
            apart += int(fingerprints.distance(prints[0][None], prints[1])[0]) > reach
            missed += not (fingerprints.band_keys(a) == fingerprints.band_keys(b)).any()
    assert apart == 0 and missed <= 1


def test_trees_part_no_pair_within_reach():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(400)], np.uint64)
    tree = fingerprints.VantageTree(np.concatenate([x, x ^ flips]), 8, 3)
    at, leaf = tree.shards(np.concatenate([x, x ^ flips]))
    shards = [set(leaf[at == i].tolist()) for i in range(800)]
    assert tree.leaves > 1 and all(shards[i] & shards[i + 400] for i in range(400))
    wide = rng.integers(0, 1 << 63, (5, 4), dtype=np.uint64)
    near = np.repeat(wide, 100, axis=0) ^ (np.uint64(1) << rng.integers(0, 63, (500, 4)).astype(np.uint64))
    tree = fingerprints.VantageTree(near, 8, 20)
    at, leaf = tree.shards(near)
    assert tree.leaves >= 5 and len(at) == 500  # families far apart share no leaf
    again = fingerprints._loaded(fingerprints._dumped(small := fingerprints.VantageTree(x, 6, 3)), 3)
    assert [a.tolist() for a in again.shards(x)] == [a.tolist() for a in small.shards(x)]


@pytest.mark.parametrize("n", [600, 2400])
def test_shards_stay_bounded_as_the_table_grows(spark, monkeypatch, n):
    for name, value in (("SAMPLE", 64), ("LEAF", 16), ("MOST", 100), ("SLICE", 300)):
        monkeypatch.setattr(fingerprints, name, value)
    rng = np.random.default_rng(n)
    half = rng.integers(0, 1 << 32, n // 3, dtype=np.uint64)
    prints = np.concatenate([rng.integers(0, 1 << 63, n // 3, dtype=np.uint64), half << np.uint64(32), (half & np.uint64(15)) ^ (np.uint64(1) << (np.arange(n // 3) % 30).astype(np.uint64))])
    prints = np.unique(prints)  # a third shares its lower half, a third is within a few bits
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    edges = [(r.u, r.v) for r in fingerprints.near_edges(df).collect()]
    at = {p: i for i, p in enumerate(prints.view(np.int64).tolist())}
    linked = np.bitwise_count(prints[:, None] ^ prints) <= 3
    got = np.eye(len(prints), dtype=bool)
    for u, v in edges:
        got[at[u], at[v]] = got[at[v], at[u]] = True
    assert (components(got) == components(linked)).all() and not (got & ~components_same(linked)).any()
    routed = spark.createDataFrame([(1, int(p)) for p in prints.view(np.int64)], "shard long, fp long")
    dealt, large = fingerprints.bounded_shards(routed, 3)
    left = {r.shard: r.n for r in large.collect()}
    counts = {r.shard: r["count"] for r in dealt.groupBy("shard").count().collect()}
    assert max([c for s, c in counts.items() if s not in left], default=0) <= 100


def components_same(linked):
    c = components(linked)
    return c[:, None] == c


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text, "a"), (2, text.replace("w150", "zz"), "b"), (3, text, None), (4, "other words " * 20, "d"), (None, text, "e"), (5, None, "f"), (6, " \t", "g"), (7, "few", "h"), (8, "few", "i"), (9, "long " * 40_000, "j"), (9, "long " * 40_000, "j"), (4, "unlike", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, other_side string")
    for c in ("Gone", "u", "v", "id", "print", "block", "node"):
        df = df.withColumn(c, df.doc_id)
    got = fingerprints.first_of_groups(df)
    assert got.columns == df.columns
    assert sorted(str((r.doc_id, r.other_side)) for r in got.collect()) == sorted(str((d, o)) for d, _, o in rows if d in (1, 4, None, 5, 7, 9))
    assert fingerprints.first_of_groups(df.where("false")).count() == 0
    prints = {(r.doc_id, r.fingerprint, r.component_id) for r in fingerprints.near_duplicates(df).collect()}
    assert {(d, c) for d, f, c in prints if f == "0" * 16} == {(5, 5), (6, 5)} and {(d, c) for d, _, c in prints if d in (1, 3, 7, 8)} == {(1, 1), (3, 1), (7, 7), (8, 7)}
