"""Embedding near-dedup: cover trees and their dual traversal.

Vectors of one label are compared as points on the unit sphere, where cosine >= t means a distance
of at most sqrt(2 - 2 t). Equal vectors are one point with a weight. The upper levels of a label's cover tree are made
by Spark, level by level: a cell of more than CELL points gets up to FAN centres, each farthest from those before
(from a bounded sample of the cell), and each point joins its nearest. Pairs of cells go down the levels together: a pair
is dropped if the centres are farther apart than both radii and the threshold, taken whole if they are nearer than
the threshold less both radii (then a tight group of any size takes one aggregate, not its pairs), and opened otherwise.

Pairs of lowest cells are tasks; a cell that stays large is dealt into chunks by hash, and pairs of chunks are tasks.
In a task each side becomes a tree with halving radii, and the two trees are walked together by the same rules. Pairs of
points are decided by their cosine in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merged, partitions, pick, read, stored, table
from .components import connected

THRESHOLD = 0.98
#: Points meant for a cell; centres of a cell's next level, at most; points they are taken from, at most about twice;
#: points that a task deals to centres; levels.
CELL, FAN, SAMPLE, SLICE, LEVELS = 1500, 64, 2000, 20_000, 6
SLACK = 1e-7
#: Radius below which a node isn't parted any more: its points are compared one by one.
NEAREST = 1e-6


class CoverTree:
    """Nested nodes with halving radii; every node keeps a centre, its covering radius and its points."""

    __slots__ = ("center", "kids", "points", "radius")

    def __init__(self, x: np.ndarray, points: np.ndarray, leaf: int = 24):
        self.points = points
        self.center = x[points[0]]
        self.radius = float(np.linalg.norm(x[points] - self.center, axis=1).max()) if len(points) > 1 else 0.0
        self.kids: list[CoverTree] = []
        # of unit vectors, one product tells all distances; of points nearer to each other than NEAREST it tells nothing
        if len(points) > leaf and self.radius > NEAREST:
            near = x[points] @ x[points].T >= 1 - self.radius**2 / 8
            open_ = np.ones(len(points), bool)
            for i in range(len(points)):
                if open_[i]:
                    mine = near[i] & open_
                    mine[i] = True
                    open_ &= ~mine
                    self.kids.append(CoverTree(x, points[mine], leaf))


def _centers(nodes: list[CoverTree]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([t.center for t in nodes]), np.array([t.radius for t in nodes])


def dual_links(x: np.ndarray, y: np.ndarray, same: bool, threshold: float):
    """(i, j) index arrays of the pairs of unit vectors at or over the cosine threshold, in groups.

    For same, x is y, and the pairs hold both orders and each point with itself.
    """
    if not len(x) or not len(y):
        return
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    a = CoverTree(x, np.arange(len(x)))
    b = a if same else CoverTree(y, np.arange(len(y)))
    open_ = [([a], [b])]
    while open_:
        left, right = open_.pop()
        (ca, ra), (cb, rb) = _centers(left), _centers(right)
        lowest_a, lowest_b = (np.array([not t.kids for t in nodes]) for nodes in (left, right))
        for s in range(0, len(left), 512):
            d = np.sqrt(np.maximum(0, (ca[s : s + 512] ** 2).sum(1)[:, None] + (cb**2).sum(1) - 2 * ca[s : s + 512] @ cb.T))
            near = d <= ra[s : s + 512, None] + rb + reach + SLACK
            # pairs of lowest nodes are decided by one product of all their points
            lowest = near & lowest_a[s : s + 512, None] & lowest_b
            if lowest.any():
                i, j = (np.concatenate([nodes[k].points for k in at]) for nodes, at in ((left, np.flatnonzero(lowest.any(axis=1)) + s), (right, np.flatnonzero(lowest.any(axis=0)))))
                yield i, j, x[i] @ y[j].T >= threshold
            for i, j in zip(*np.nonzero(near & ~lowest), strict=True):
                p, q = left[s + i], right[j]
                if d[i, j] + p.radius + q.radius <= reach - SLACK:
                    yield p.points, q.points, None
                else:
                    open_.append((p.kids or [p], q.kids or [q]))


def unit(column, d: int) -> np.ndarray:
    """Rows of unit length from an Arrow column of lists of d numbers. The largest part of each is made one first, so that
    no square is too large or too small."""
    x = column.combine_chunks().flatten().to_numpy().reshape(-1, d)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cell_links(x: np.ndarray, y: np.ndarray | None, weights: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For the points of one chunk, or of two, one after the other: the weight of the points that each links with, and
    the place of a point that stands for its component among them."""
    shift = 0 if y is None else len(x)
    count, label = np.zeros(len(weights), np.int64), np.arange(len(weights))
    for i, j, hit in dual_links(x, x if y is None else y, y is None, threshold):
        j = j + shift
        if hit is None:
            count[i] += weights[j].sum()
            if shift:
                count[j] += weights[i].sum()
            merged(label, np.concatenate([i, j]))
            continue
        count[i] += hit @ weights[j]
        if shift:
            count[j] += weights[i] @ hit
        for k in np.flatnonzero(hit.any(axis=1)):
            linked = j[hit[k]]
            if (label[linked] != label[i[k]]).any():
                merged(label, np.append(linked, i[k]))
    return count, label


def centers_of(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n centres, each farthest from those before it."""
    chosen, d = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < n and d.max() > 1e-9:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


SPACE = ["label", "d"]
NETS = "label string, d int, cell string, centers array<array<double>>"
SETTLED = "label string, d int, parent string, child int, id long, weight long, vector array<double>, far double"


def next_level(placed: DataFrame, large: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """The points of the large cells in cells of the next level, and these cells: parent, cell, far, n, center.

    placed has label, d, id, weight, vector and cell; large has label, d, cell and the number n of its points. A net is made
    from a bounded sample. A cell is dealt in slices, each with the cell's net of at most FAN centres.
    """

    def net(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        label, d, cell = (k.as_py() for k in key)
        c = centers_of(unit(rows.column("vector"), d), min(FAN, math.ceil(rows.column("n")[0].as_py() / CELL)))
        return pa.table([pa.array([label], pa.string()), pa.array([d], pa.int32()), pa.array([cell], pa.string()), pa.array([c.tolist()], pa.list_(pa.list_(pa.float64())))], names=["label", "d", "cell", "centers"])

    points = placed.join(large.select(*SPACE, "cell", "n"), [*SPACE, "cell"])
    some = points.where(F.expr(f"pmod(xxhash64(id, {level}), greatest(1L, n div {SAMPLE})) = 0"))
    nets = stored(some.groupBy(*SPACE, "cell").applyInArrow(net, NETS), "nets")

    def settle(points: pa.Table, nets: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in SETTLED.split(", ")]
        n = points.num_rows
        if n and not nets.num_rows:
            raise RuntimeError("a cell's sample is empty")
        if n:
            d = points.column("d")[0].as_py()
            x, c = unit(points.column("vector"), d), np.array(nets.column("centers")[0].as_py()).reshape(-1, d)
            child = (x @ c.T).argmax(axis=1)
            far = np.linalg.norm(x - c[child], axis=1)
        else:
            child = far = np.zeros(0)
        points = points.slice(0, n)
        return pa.table([points.column("label"), points.column("d"), points.column("cell"), pa.array(child, pa.int32()), points.column("id"), points.column("weight"), points.column("vector"), pa.array(far)], names=names)

    slices = large.select(*SPACE, "cell", F.ceil(F.col("n") / SLICE).alias("slices"))
    sent = points.join(slices, [*SPACE, "cell"]).withColumn("slice", F.expr("pmod(xxhash64(id, 3), slices)"))
    each = nets.join(slices, [*SPACE, "cell"]).select(*[F.col(c).alias(c) for c in (*SPACE, "cell", "centers")], F.explode(F.expr("sequence(0L, slices - 1)")).alias("slice"))
    keys = [*SPACE, "cell", "slice"]
    settled = sent.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInArrow(settle, SETTLED)
    settled = stored(settled.withColumn("cell", F.format_string("%s.%d", "parent", "child")), "settled")
    kids = settled.groupBy(*SPACE, "parent", "cell", "child").agg(F.max("far").alias("far"), F.count("*").alias("n"))
    kids = kids.join(nets.withColumnRenamed("cell", "parent"), [*SPACE, "parent"]).select(*SPACE, "parent", "cell", "far", "n", F.get("centers", F.col("child")).alias("center"))
    return settled.select(*placed.columns), stored(kids, "kids")


def opened(pairs: DataFrame, kids: DataFrame, reach: float) -> DataFrame:
    """Pairs (label, d, a, b) of cells and a cell's facts, with each cell that has kids replaced by these, and whole,
    whether all their points link. Pairs that the covering radii part are gone."""
    sides = pairs
    for s in "ab":
        facts = kids.select(*SPACE, F.col("parent").alias(s), *[F.col(c).alias(f"new_{c}_{s}") for c in ("cell", "far", "center")])
        sides = sides.join(facts, [*SPACE, s], "left")
    new = {f"{c}{s}": F.coalesce(f"new_{name}_{s}", f"{c}{s}") for s in "ab" for c, name in (("far_", "far"), ("center_", "center"))}
    cells = {s: F.coalesce(f"new_cell_{s}", s) for s in "ab"}
    sides = sides.withColumn("one", F.col("a") == F.col("b")).select(*SPACE, "one", *[c.alias(s) for s, c in cells.items()], *[c.alias(s) for s, c in new.items()])
    sides = sides.where("NOT one OR a <= b")
    apart = F.sqrt(F.aggregate(F.zip_with("center_a", "center_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda x, y: x + y))
    apart = F.when(F.col("a") == F.col("b"), 0.0).otherwise(apart)
    met = sides.withColumn("apart", apart).where(F.col("apart") <= F.col("far_a") + F.col("far_b") + reach + 1e-5)
    return met.select(*SPACE, "a", "b", "far_a", "far_b", "center_a", "center_b", (F.col("apart") + F.col("far_a") + F.col("far_b") <= reach - 1e-5).alias("whole"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Rows link when their labels are equal and not null and their cosine is at least threshold. Null,
    empty and zero vectors, and those with null or non-finite parts, link with nothing; so do vectors of
    different lengths. Equal rows are copies that link with each other. Parts of any magnitude are fine.
    An empty table gives no row. Each row is a vector of its own, also where ids repeat: links are counted and followed
    between rows, and component_id is the least id in a row's component. A null id counts for links but not for that: it is null
    only where no row of the component has an id, and all those rows are kept.
    """
    spark = vectors.sparkSession
    rows = pick(vectors, vec_id=id_col, vector=vector_col, label=label_col).withColumn("vector", F.col("vector").cast("array<double>"))
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("usable", F.coalesce(sound & F.col("label").isNotNull(), F.lit(False)))
    key = [F.col("label").cast("string").alias("label"), F.size("vector").alias("d"), "vector"]
    # the points' numbers are fixed once they are written
    points = rows.where("usable").groupBy(*key).agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"))
    points = stored(points.withColumn("id", F.monotonically_increasing_id()), "points")
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))

    placed = points.drop("least_id").withColumn("cell", F.lit(""))
    cells = placed.groupBy(*SPACE, "cell").agg(F.lit(2.0).alias("far"), F.count("*").alias("n"))
    nothing = F.lit(None).cast("array<double>")
    pairs = cells.select(*SPACE, F.col("cell").alias("a"), F.col("cell").alias("b"), F.lit(2.0).alias("far_a"), F.lit(2.0).alias("far_b"), nothing.alias("center_a"), nothing.alias("center_b"))
    taken = []
    for level in range(LEVELS):
        large = stored(cells.where((F.col("n") > CELL) & (F.col("far") > 1e-9)), "large")
        if not large.head(1):
            break
        deeper, cells = next_level(placed, large, level)
        placed = placed.join(large.select(*SPACE, "cell"), [*SPACE, "cell"], "left_anti").select(*placed.columns).unionByName(deeper)
        met = stored(opened(pairs, cells, reach), "pairs")
        taken.append(met.where("whole").select(*SPACE, "a", "b"))
        pairs = met.where("NOT whole").drop("whole")

    # pairs of cells that link as a whole, where both sides are answered by one aggregate of the other
    whole = pairs.where("false").select(*SPACE, "a", "b")
    for part in taken:
        whole = whole.unionByName(part)
    both = whole.select(*SPACE, F.col("a").alias("ours"), F.col("b").alias("theirs")).unionByName(whole.where("a <> b").select(*SPACE, F.col("b").alias("ours"), F.col("a").alias("theirs")))
    # a cell taken whole may have been split since, for other pairs: its points are those of all cells below
    paths = placed.select(*SPACE, "id", "weight", F.col("cell").alias("lowest"))
    wanted = both.select(*SPACE, F.col("ours").alias("cell")).distinct()
    above = F.expr("transform(sequence(1, size(split(lowest, '[.]'))), n -> array_join(slice(split(lowest, '[.]'), 1, n), '.'))")
    members = stored(paths.withColumn("cell", F.explode(above)).join(wanted, [*SPACE, "cell"]).select(*SPACE, "cell", "id", "weight"), "whole")
    sums = stored(members.groupBy(*SPACE, "cell").agg(F.sum("weight").alias("total"), F.min("id").alias("least")), "sums")
    met = both.join(sums.withColumnRenamed("cell", "theirs"), [*SPACE, "theirs"])
    met = stored(met.groupBy(*SPACE, F.col("ours").alias("cell")).agg(F.sum("total").alias("links"), F.min("least").alias("root")), "met")
    # a cell's points all link with the least point of one cell, and by it with each other
    from_whole = members.join(met, [*SPACE, "cell"]).select("id", "links", "root")
    bridges = both.join(sums.withColumnRenamed("cell", "theirs"), [*SPACE, "theirs"]).select(*SPACE, F.col("ours").alias("cell"), F.col("least").alias("v")).join(sums, [*SPACE, "cell"]).select(F.col("least").alias("u"), "v")

    sizes = placed.groupBy(*SPACE, "cell").agg(F.ceil(F.count("*") / CELL).alias("chunks"))
    sizes = stored(sizes, "sizes")
    for s in "ab":
        pairs = pairs.join(sizes.select(*SPACE, F.col("cell").alias(s), F.col("chunks").alias(f"chunks_{s}")), [*SPACE, s])
    pairs = pairs.withColumn("i", F.explode(F.expr("sequence(0L, chunks_a - 1)"))).withColumn("j", F.explode(F.expr("sequence(0L, chunks_b - 1)"))).where("a <> b OR i <= j")
    pairs = pairs.select(*SPACE, "a", "i", "b", "j")
    sides = pairs.withColumns({"cell": F.col("a"), "chunk": F.col("i"), "first": F.lit(True)}).unionByName(pairs.where("a <> b OR i < j").withColumns({"cell": F.col("b"), "chunk": F.col("j"), "first": F.lit(False)}))
    parts = placed.join(sizes, [*SPACE, "cell"]).withColumn("chunk", F.expr("pmod(xxhash64(id, 31), chunks)")).drop("chunks")
    dealt = parts.join(sides, [*SPACE, "cell", "chunk"]).select(*SPACE, "id", "weight", "vector", "first", "a", "i", "b", "j")

    def compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        d = key[1].as_py()
        group = group.sort_by([("first", "descending"), ("id", "ascending")])
        n = int(group.column("first").to_numpy().sum())
        x = unit(group.column("vector"), d)
        ids, one = group.column("id").to_numpy(), key[2:4] == key[4:6]
        count, label = cell_links(x[:n], None if one else x[n:], group.column("weight").to_numpy(), threshold) if one or n < len(x) else (np.zeros(n, np.int64), np.arange(n))
        return table("id long, links long, root long", ids, count, ids[label])

    task = [*SPACE, "a", "i", "b", "j"]
    compared = dealt.repartition(partitions(spark), *task).groupBy(*task).applyInArrow(compare, "id long, links long, root long")
    found = stored(compared.unionByName(from_whole), "links")
    roots = connected(found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(bridges))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = points.select("label", "d", "vector", "id", "least_id").join(links, "id").join(roots, F.col("id") == F.col("node"), "left")
    named = stored(named.select("label", "d", "vector", "links", "least_id", F.coalesce("root", "id").alias("root")), "named")
    # written before it is joined, so that the rows of a large component can be dealt to several tasks
    leasts = stored(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "leasts")
    named = named.join(leasts, "root").select("label", "d", "vector", "links", "component_id")
    keyed = rows.where("usable").select("vec_id", *key).join(named, ["label", "d", "vector"])
    linked = keyed.select("vec_id", (F.col("links") - 1).alias("n_links"), "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


OP8_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a), m AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m.m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m.m, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""
