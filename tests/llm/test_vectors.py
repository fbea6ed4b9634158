"""Linked vectors against brute force: odd vectors, tight groups, many levels, extreme magnitudes."""

import numpy as np
import pytest

from sessionloom.llm import vectors

from .test_operators import components


def linked_rows(x, label):
    """vec_id, n_links, component_id and kept, by all pairs."""
    x = np.array(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (np.array(label)[:, None] == np.array(label))
    return [(i, int(linked[i].sum()) - 1, int(c), i == c) for i, c in enumerate(components(linked))]


def frame(spark, x, label, more=()):
    return spark.createDataFrame([(i, list(map(float, v)), c) for i, (v, c) in enumerate(zip(x, label, strict=True))] + list(more), "vec_id long, embedding array<double>, label int")


def got(df):
    return sorted(tuple(r) for r in vectors.near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect())


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 20)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 8))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.05, base[:5], base * 3])
    label = [i % 2 for i in range(len(x))]
    bad = [(900, None, 1), (901, [0.0] * 8, 1), (902, [1.0, None] * 4, 1), (903, [float("nan")] * 8, 1), (904, [1.0] * 8, None), (905, [], 0), (906, [float("inf")] * 8, 1)]
    df = frame(spark, x, label, bad)
    for name in ("id", "d", "weight", "cell", "usable", "n"):
        df = df.withColumn(name, df.vec_id)
    assert got(df) == linked_rows(x, label) + [(b[0], 0, b[0], True) for b in bad]
    assert vectors.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("scale", [1e-200, 1e200, 5e-324])
def test_extreme_magnitudes(spark, scale):
    x = np.ones((4, 3)) * [[1], [2], [3], [4]]
    x[3] = scale
    assert got(frame(spark, x, [1] * 4)) == linked_rows(x, [1] * 4) and linked_rows(x, [1] * 4)[0][1] == 3


@pytest.mark.parametrize("spread", [0.001, 0.02, 0.06])
def test_a_tight_group(spark, monkeypatch, spread):
    monkeypatch.setattr(vectors, "CELL", 20)
    whole = vectors.cell_links

    def bounded(x, y, weights, threshold):
        assert len(weights) <= 120
        return whole(x, y, weights, threshold)

    monkeypatch.setattr(vectors, "cell_links", bounded)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=8) + rng.normal(size=(200, 8)) * spread, rng.normal(size=(100, 8))])
    assert got(frame(spark, x, [1] * 300)) == linked_rows(x, [1] * 300)


@pytest.mark.parametrize("n", [300, 1500])
def test_cells_stay_bounded_as_the_table_grows(spark, monkeypatch, n):
    for name, value in (("CELL", 30), ("FAN", 4), ("SAMPLE", 40), ("SLICE", 100)):
        monkeypatch.setattr(vectors, name, value)
    seen = []
    whole = vectors.next_level
    monkeypatch.setattr(vectors, "next_level", lambda *a: seen.append(whole(*a)) or seen[-1])
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n // 6, 4)).repeat(6, axis=0) + rng.normal(size=(n, 4)) * 0.05
    label = [int(i % 7 == 0) for i in range(n)]
    assert got(frame(spark, x, label)) == linked_rows(x, label)
    assert len(seen) >= 2
    lowest = {r.cell: r.n for _, kids in seen for r in kids.select("cell", "n").collect()}
    parents = {r.parent for _, kids in seen for r in kids.select("parent").distinct().collect()}
    assert max(n for c, n in lowest.items() if c not in parents) <= 90


def test_whole_pairs_of_cells_of_several_levels(spark, monkeypatch):
    for name, value in (("CELL", 10), ("FAN", 3), ("SAMPLE", 40), ("SLICE", 50)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(9)
    centre = rng.normal(size=16)
    families = [centre + rng.normal(size=16) * s for s in (0.0, 0.01, 0.02, 0.1, 0.2, 3.0)]
    x = np.concatenate([f + rng.normal(size=(60, 16)) * 0.004 for f in families])
    assert got(frame(spark, x, [1] * len(x))) == linked_rows(x, [1] * len(x))


def test_large_ids(spark):
    big = (1 << 53) + 1
    df = spark.createDataFrame([(big, [1.0, 0.0], 1), (big + 1, [2.0, 0.0], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label long")
    assert {(r.vec_id, r.n_links) for r in vectors.near_vectors(df).collect()} == {(big, 2), (big + 1, 2), (None, 2)}


def test_null_and_repeated_ids(spark):
    """Rows are vectors of their own: links between rows, components named by their least id."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(12, 4))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.05, base[:6]])
    ids = [None if i % 5 == 0 else int(rng.integers(0, 9)) for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, label int")
    rows = linked_rows(x, [1] * len(x))
    least = {c: min((ids[i] for i, _, d, _ in rows if d == c and ids[i] is not None), default=None) for c in {r[2] for r in rows}}
    wanted = [(ids[i], n, least[c], ids[i] == least[c]) for i, n, c, _ in rows]
    assert sorted(map(str, got_rows(df))) == sorted(map(str, wanted))
    few = spark.createDataFrame([(7, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (8, [0.001, 1.0], 1), (None, [5.0, 5.0], 2)], "vec_id long, embedding array<double>, label int")
    assert sorted(map(str, got_rows(few))) == sorted(map(str, [(7, 0, 7, True), (7, 1, 7, True), (8, 1, 7, False), (None, 0, None, True)]))


def got_rows(df):
    return [tuple(r) for r in vectors.near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect()]


@pytest.mark.parametrize("step", [1e-9, 1e-8, 1e-7, 1e-6, 1e-5])
def test_vectors_that_all_but_coincide(spark, step):
    x = np.tile(np.random.default_rng(4).normal(size=64), (90, 1)).astype(np.float32).astype(np.float64)
    x[:, 0] += step * np.arange(90)
    x[80:] = np.random.default_rng(5).normal(size=(10, 64))
    assert got(frame(spark, x, [1] * 90)) == linked_rows(x, [1] * 90)
