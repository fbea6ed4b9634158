"""SimHash near-dedup over vantage-point trees.

A vantage-point tree parts points by their Hamming distance to a vantage point: nearer ones go inside, others
outside. By the triangle inequality two points within `reach` of each other can only be parted if the outer one
lies at most `reach` beyond the border, so such points are sent inside as well. Every leaf is a shard, and
every pair within reach is together in one; a branch that a border can't cut is left whole.

Fingerprints of 64 bits link at few differing bits. If two differ in at most `radius` bits, one of their
`radius // 2 + 1` segments differs in at most one, so a tree is made for each segment. Shards that are too
large get trees of their own over all 64 bits, level by level; one that no tree can part is dealt into
parts, each pair of them a task. Equal fingerprints are one row from the start, and a shard answers with stars,
never with all pairs.

Near copies by shingle similarity (`first_of_groups`) take 256-bit fingerprints and a reach that hardly any pair of the
similarity exceeds. At this distance a tree over a whole corpus parts nothing, so documents are first dealt to shards
by bands of least shingle hashes; a tree over the fingerprints of each shard finds the pairs within reach, and the exact
similarity of these decides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, grouped, merged, mix64, partitions, pick, read, spans, stored, table
from .components import connected

BITS = 64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Points from which a tree is made, at most about twice this, and those meant for a leaf.
SAMPLE, LEAF, DEPTH = 8192, 2048, 24
#: Points of a shard, over which it is split; levels of trees over all bits; points of a task that deals them.
MOST, LEVELS, SLICE = 8192, 6, 1 << 20


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` words; of all words if there are fewer; none if no word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    starts = spans(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    digest = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), (starts[size:] - 1).tolist(), strict=True)), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little") if len(hashes) else 0


def fingerprinted(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of docs(doc_id, text)."""

    def run(batches):
        for batch in batches:
            prints = np.array([simhash(shingle_hashes(t, shingle)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _segment(fp: np.ndarray, s: int, of: int) -> np.ndarray:
    a, b = BITS * s // of, BITS * (s + 1) // of
    return (fp >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)


def distance(points: np.ndarray, v) -> np.ndarray:
    """Differing bits of each point, a word or a row of words, and v."""
    d = np.bitwise_count(points ^ v)
    return d.astype(np.int64) if d.ndim == 1 else d.sum(axis=-1, dtype=np.int64)


class VantageTree:
    """A tree over points; its nodes are (vantage point, border, inside, outside), leaves are negative numbers."""

    def __init__(self, sample: np.ndarray, depth: int, reach: int = 1):
        self.reach = reach
        self.nodes: list[tuple] = []
        self.leaves = 0
        self.root = self._grow(np.unique(sample, axis=0), depth)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, points: np.ndarray, depth: int) -> int:
        if depth == 0 or len(points) < 4:
            return self._leaf()
        best = None
        for v in points[:: max(1, len(points) // 8)][:8]:
            inner = np.cumsum(np.bincount(distance(points, v), minlength=BITS * v.size + self.reach + 2))
            # a point beyond the border by at most the reach is in both branches
            cost = inner[self.reach :].astype(float) ** 2 + (len(points) - inner[: len(inner) - self.reach]).astype(float) ** 2
            k = int(np.argmin(cost))
            if best is None or cost[k] < best[0]:
                best = (cost[k], v, k)
        cost, v, border = best
        if cost >= float(len(points)) ** 2:
            return self._leaf()
        near, here = distance(points, v), len(self.nodes)
        self.nodes.append(())
        inside, outside = self._grow(points[near <= border + self.reach], depth - 1), self._grow(points[near > border], depth - 1)
        self.nodes[here] = (v, border, inside, outside)
        return here

    def shards(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): the leaf each value lies in, and those it is sent to across a border."""
        rows, leaves, open_ = [], [], [(self.root, np.arange(len(values)))]
        while open_:
            node, at = open_.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), -node - 1))
                continue
            v, border, inside, outside = self.nodes[node]
            d = distance(values[at], v)
            open_ += [(inside, at[d <= border + self.reach]), (outside, at[d > border])]
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, np.int64),) * 2


def stars(n: int, linked, step: int = 512) -> np.ndarray:
    """The least index of the component of each of n points. linked(i, j) is the boolean matrix of
    point arrays i by j. Each point is searched from once, among the points not found yet."""
    root = np.arange(n)
    has = np.zeros(n, bool)
    everyone = np.arange(n)
    for a in range(0, n, step):
        i = everyone[a : a + step]
        hit = linked(i, everyone[a:])
        hit[np.arange(len(i)), np.arange(len(i))] = False
        has[i] |= hit.any(axis=1)
        has[a:] |= hit.any(axis=0)
    left = np.flatnonzero(has)
    while len(left):
        first, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = linked(front[:step], left).any(axis=0)
            new = left[hit]
            root[new] = first
            front, left = np.concatenate([front[step:], new]), left[~hit]
    return root


def depth_for(n: int, leaf: int) -> int:
    return min(DEPTH, max(1, math.ceil(1.6 * math.log2(max(2, n / leaf)))))


def split(dealt: DataFrame, large: DataFrame, reach: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The points of the large shards in the leaves of trees of their own, and the shards that no tree parts.

    dealt has shard and fp, large has shard and its size n. A tree comes from a bounded sample of the shard; a
    shard is dealt in slices, each with the tree, so that no task holds more than about SLICE points.
    """
    points = dealt.join(large, "shard")

    def grow(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        sample = np.sort(rows.column("fp").to_numpy()).view(np.uint64)
        tree = VantageTree(sample, depth_for(rows.column("n")[0].as_py(), LEAF), reach)
        return table("shard long, tree binary, leaves long", [key[0].as_py()], [_dumped(tree)], [tree.leaves])

    some = points.where(F.expr(f"pmod(xxhash64(fp, {seed}), greatest(1L, n div {SAMPLE})) = 0"))
    trees = stored(some.groupBy("shard").applyInArrow(grow, "shard long, tree binary, leaves long"), "trees")

    def route(points: pa.Table, tree: pa.Table) -> pa.Table:
        if not points.num_rows or not tree.num_rows:
            return table("shard long, leaf long, fp long")
        fp = points.column("fp").to_numpy()
        at, leaf = _loaded(tree.column("tree")[0].as_py(), reach).shards(fp.view(np.uint64))
        return table("shard long, leaf long, fp long", np.repeat(points.column("shard").to_numpy()[:1], len(at)), leaf, fp[at])

    slices = large.withColumn("slices", F.ceil(F.col("n") / SLICE)).drop("n")
    planted = trees.where("leaves > 1").select("shard", "tree").join(slices, "shard")
    sent = points.drop("n").join(planted.select("shard", "slices"), "shard").withColumn("slice", F.expr("pmod(xxhash64(fp, 3), slices)"))
    each = planted.select(F.col("shard").alias("shard"), F.col("tree").alias("tree"), F.explode(F.expr("sequence(0L, slices - 1)")).alias("slice"))
    routed = sent.groupBy("shard", "slice").cogroup(each.groupBy("shard", "slice")).applyInArrow(route, "shard long, leaf long, fp long")
    return routed.select(F.xxhash64("shard", "leaf", F.lit(seed)).alias("shard"), "fp"), large.join(planted.select("shard"), "shard", "left_anti")


def _dumped(tree: VantageTree) -> bytes:
    rows = [(np.uint64(v).astype(np.int64), border, inside, outside) for v, border, inside, outside in tree.nodes]
    return np.array([(0, tree.leaves, tree.root, 0), *rows], "<i8").tobytes()


def _loaded(data: bytes, reach: int) -> VantageTree:
    rows = np.frombuffer(data, "<i8").reshape(-1, 4)
    tree = VantageTree(np.zeros(0, np.uint64), 0, reach)
    tree.leaves, tree.root = int(rows[0, 1]), int(rows[0, 2])
    tree.nodes = [(np.int64(v).astype(np.uint64), int(b), int(i), int(o)) for v, b, i, o in rows[1:]]
    return tree


def bounded_shards(dealt: DataFrame, reach: int) -> tuple[DataFrame, DataFrame]:
    """dealt(shard, fp) with large shards split level by level, and shard and n of those that stay large."""
    spark = dealt.sparkSession
    kept, stuck = [], []
    for level in range(LEVELS):
        large = stored(dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > MOST), "large")
        if not large.head(1):
            break
        parted, whole = split(dealt, large, reach, 100 + level)
        whole = stored(whole, "whole")
        kept += [dealt.join(large, "shard", "left_anti"), dealt.join(whole, "shard", "left_semi")]
        stuck.append(whole)
        dealt = stored(parted.distinct(), "shards")
    else:
        stuck.append(stored(dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > MOST), "large"))
    for part in kept:
        dealt = dealt.unionByName(part)
    left = spark.createDataFrame([], "shard long, n long")
    for part in stuck:
        left = left.unionByName(part)
    return dealt, left


def near_edges(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (u, v) that join the distinct fingerprints fp within radius bits as all links would."""
    spark = prints.sparkSession
    n = prints.count()
    of = radius // 2 + 1
    keep = max(1, n // SAMPLE)
    sample = np.array([r.fp for r in prints.where(F.expr(f"pmod(xxhash64(fp, 7), {keep}L) = 0")).collect()], np.int64).view(np.uint64)
    trees = spark.sparkContext.broadcast([VantageTree(_segment(sample, s, of), depth_for(n, LEAF)) for s in range(of)])

    def route(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            at, shard, base = [], [], 0
            for s, tree in enumerate(trees.value):
                i, leaf = tree.shards(_segment(fp.view(np.uint64), s, of))
                at.append(i)
                shard.append(leaf + base)
                base += tree.leaves
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shard).astype(np.int64)), pa.array(fp[np.concatenate(at)])], ["shard", "fp"])

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        fp = np.unique(rows.column("fp").to_numpy())
        bits = fp.view(np.uint64)
        root = stars(len(fp), lambda i, j: np.bitwise_count(bits[i][:, None] ^ bits[j]) <= radius)
        at = np.flatnonzero(root != np.arange(len(fp)))
        return table("u long, v long", fp[at], fp[root[at]])

    dealt, large = bounded_shards(stored(prints.select("fp").mapInArrow(route, "shard long, fp long"), "shards"), radius)
    parts = large.select("shard", F.ceil(F.col("n") / MOST).alias("parts"))
    placed = dealt.join(parts, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn("part", F.expr("pmod(xxhash64(fp, 5), parts)"))
    tasks = placed.withColumn("other", F.explode(F.expr("filter(sequence(0L, parts - 1), x -> parts = 1 OR x <> part)")))
    tasks = tasks.select("shard", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "fp")
    return tasks.repartition(partitions(spark), "shard", "a", "b").groupBy("shard", "a", "b").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable), for each row.

    Null and blank texts have fingerprint zero and link like others. Equal rows
    and rows of one id are judged row by row and end in one component. A null id is never the
    component's id unless all its ids are null.
    """
    prints = stored(fingerprinted(pick(docs, doc_id=id_col, text=text_col), shingle).select("doc_id", "fp"), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected(near_edges(distinct, radius))
    of_print = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of_print.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of_print.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of the fingerprints that near copies are looked for with; bands of least hashes, and hashes in a band: two sets of
#: similarity 0.8 share none of 14 bands of 4 once in 1,600 times. Standard errors of leniency in the distance.
WORDS, BANDS, ROWS, ROOM = 4, 14, 4, 4.0
#: Fingerprints of a task that looks for pairs within reach; shingles of a task that compares sets, where a set
#: counts as EACH more.
POINTS, SHARE, EACH = 8192, 1 << 20, 512
#: Room for rounding where a number of shingles is held against a share of others.
HAIR = 1e-9
_PERMUTED = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def reach_for(similarity: float, bits: int = BITS * WORDS) -> int:
    """Bits in which the fingerprints of two sets of this Jaccard similarity hardly ever differ more.

    A bit differs with the angle between the sets over pi; the angle is widest for sets of one size.
    """
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.ceil(bits * p + ROOM * math.sqrt(bits * p * (1 - p)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: the least hashes of its permutations of the set."""
    least = np.full(len(_PERMUTED), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 1 << 12):
            least = np.minimum(least, (hashes[i : i + (1 << 12)] * _PERMUTED[:, None]).min(axis=1))
        key = np.arange(BANDS, dtype=np.uint64)
        for column in least.reshape(BANDS, ROWS).T:
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def shingled(rows: DataFrame, shingle: int) -> DataFrame:
    """For rows(doc_id, print, text): doc_id, print, digest of the set of shingles, n, its size, its fingerprint fp in
    words of 64 bits, and its bands' keys."""

    def run(batches):
        for batch in batches:
            digests, sizes, prints, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                h = np.unique(shingle_hashes(text, shingle))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                with np.errstate(over="ignore"):
                    prints.append(np.array([simhash(mix64(h + np.uint64(k))) for k in range(WORDS)], np.uint64).view(np.int64))
                keys.append(band_keys(h).view(np.int64) if len(h) else np.zeros(0, np.int64))
            longs = pa.list_(pa.int64())
            columns = [*batch.columns[:2], pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints, longs), pa.array(keys, longs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "digest", "n", "fp", "bands"])

    return rows.select("doc_id", "print", "text").mapInArrow(run, "doc_id long, print long, digest binary, n long, fp array<long>, bands array<long>")


def in_tasks(members: DataFrame, share: int) -> DataFrame:
    """members(block, comp, load and others) with the tasks (i, j, mixed) that each of them goes to, so that two members of
    a block that are not of one component meet in a task.

    In each block the component with the largest load is the main one. Its members don't have to meet each other: they
    are dealt into parts, and the others, in parts of their own, meet each part of them and each other's.
    """
    by_comp = members.groupBy("block", "comp").agg(F.sum("load").alias("load"))
    blocks = by_comp.groupBy("block").agg(F.max_by("comp", F.struct("load", "comp")).alias("main"), F.max("load").alias("most"), F.sum("load").alias("all"))
    blocks = blocks.where(F.col("all") > F.col("most")).select("block", "main", F.ceil(F.col("most") / share).alias("p"), F.ceil((F.col("all") - F.col("most")) / share).alias("q"))
    blocks = stored(blocks, "open")
    placed = members.join(blocks, "block").withColumn("part", F.expr("pmod(xxhash64(id, 29), if(comp = main, p, q))"))
    mixed = F.expr("transform(sequence(0L, if(comp = main, q, p) - 1), x -> if(comp = main, named_struct('i', x, 'j', part, 'mixed', true), named_struct('i', part, 'j', x, 'mixed', true)))")
    others = F.expr("transform(filter(sequence(0L, q - 1), x -> comp <> main AND x <> part), x -> named_struct('i', least(part, x), 'j', greatest(part, x), 'mixed', false))")
    return placed.withColumn("task", F.explode(F.concat(mixed, others))).select("*", "task.*").drop("task", "part", "p", "q")


TASK = ("block", "i", "j", "mixed")


def fitting(n: np.ndarray, i: int, similarity: float) -> np.ndarray:
    """Which set sizes let a set have the similarity with set i."""
    return np.minimum(n, n[i]) + HAIR >= similarity * np.maximum(n, n[i])


def within_reach(points: np.ndarray, n: np.ndarray, comp: np.ndarray, main, similarity: float, reach: int) -> np.ndarray:
    """The least index of the group of each point; two points not of one component within reach are in one group."""
    group = np.arange(len(points))
    at, leaf = VantageTree(points, depth_for(len(points), 64), reach).shards(points)
    for here in np.split(at[np.argsort(leaf, kind="stable")], np.flatnonzero(np.diff(np.sort(leaf))) + 1):
        for i in here[comp[here] != main]:
            hit = here[(comp[here] != comp[i]) & (distance(points[here], points[i]) <= reach)]
            hit = hit[np.minimum(n[hit], n[i]) + HAIR >= similarity * np.maximum(n[hit], n[i])]
            if len(hit):
                merged(group, np.append(hit, i))
    return group


class Sets:
    """Sets of hashes, none empty, held as places in their common vocabulary."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        values, places = np.unique(np.concatenate(sets), return_inverse=True)
        self.places = np.split(places, np.cumsum(self.sizes)[:-1])
        self.flags = np.zeros(len(values), np.uint8)

    def similar(self, i: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Which of the other sets have the Jaccard similarity with set i."""
        self.flags[self.places[i]] = 1
        both = np.add.reduceat(self.flags[np.concatenate([self.places[j] for j in others])], spans(self.sizes[others])[:-1], dtype=np.int64)
        self.flags[self.places[i]] = 0
        return both + HAIR >= similarity * (self.sizes[i] + self.sizes[others] - both)


def exact_links(ids: np.ndarray, comp: np.ndarray, main, points: np.ndarray, sets: Sets, similarity: float, reach: int) -> list[tuple[int, int]]:
    """Pairs of ids with the similarity that join the components as all such pairs within reach would."""
    label, found = np.unique(comp, return_inverse=True)[1], []
    for i in np.flatnonzero(comp != main):
        near = np.flatnonzero((label != label[i]) & (distance(points, points[i]) <= reach) & fitting(sets.sizes, i, similarity))
        if len(near):
            near = near[sets.similar(i, near, similarity)]
            # one link to each component that is joined is enough
            near = near[np.unique(label[near], return_index=True)[1]]
            found += [(int(ids[i]), int(ids[j])) for j in near]
            merged(label, np.append(near, i))
    return found


def _points(column) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Of pairs (u, v, with their prints and n), those whose texts have the similarity: one set v against many.

    texts has doc_id, print and text. A v with very many partners is dealt into shares.
    """
    shares = stored(pairs.groupBy("v", "v_print").agg(F.ceil(F.sum(F.col("n") + EACH) / SHARE).alias("shares")), "shares")
    dealt = pairs.join(shares, ["v", "v_print"]).withColumn("share", F.expr("pmod(xxhash64(u, 31), shares)"))
    sides = dealt.select("v", "v_print", "share", F.col("u").alias("id"), F.col("u_print").alias("print"), F.lit(1).alias("side"))
    sides = sides.unionByName(dealt.select("v", "v_print", "share", F.col("v").alias("id"), F.col("v_print").alias("print"), F.lit(0).alias("side")).distinct())

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("side", "ascending"), ("id", "ascending")])
        sets = [np.unique(shingle_hashes(t, shingle)) for t in rows.column("text").to_pylist()]
        if rows.num_rows < 2:
            return table("u long, v long")
        hit = np.flatnonzero(Sets(sets).similar(0, np.arange(1, len(sets)), similarity)) + 1
        ids = rows.column("id").to_numpy()
        return table("u long, v long", ids[hit], np.repeat(ids[:1], len(hit)))

    return grouped(sides.join(texts.withColumnRenamed("doc_id", "id"), ["id", "print"]), ("v", "v_print", "share"), compare, "u long, v long")


def similar_edges(rows: DataFrame, classes: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Edges (u, v) that join the ids of rows(doc_id, print, text) as all pairs of sets with the similarity would.

    classes has id, print, n, fp and bands of each distinct set. Sets that share a band's key are a shard, and each is
    compared with the shard's first one, which settles a shard of near copies however large. In the
    others vantage-point trees find the pairs within reach that aren't of one component yet; groups of such
    pairs, over all shards, are compared by their sets.
    """
    reach = reach_for(similarity)
    # of two unequal sets with the similarity, the larger has at least 1 / (1 - similarity) shingles and the other one less
    facts = classes.where(F.col("n") * (1 - similarity) >= similarity - HAIR).select("id", "print", "n", "fp")
    keys = classes.where(F.col("n") * (1 - similarity) >= similarity - HAIR).select("id", F.explode("bands").alias("block"))
    # stored before it is joined, so that the join with a hot band's rows can be split
    firsts = stored(keys.groupBy("block").agg(F.min("id").alias("first"), F.count("*").alias("sets")).where("sets > 1"), "firsts")
    shards = stored(keys.join(firsts, "block"), "bands")

    u, v = (facts.select(*[F.col(c).alias(f"{side}_{c}") for c in ("print", "n", "fp")], F.col("id").alias(side)) for side in "uv")
    apart = F.aggregate(F.zip_with("u_fp", "v_fp", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    pairs = shards.where("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v")).distinct().join(u, "u").join(v, "v")
    pairs = pairs.where((F.least("u_n", "v_n") + HAIR >= similarity * F.greatest("u_n", "v_n")) & (apart <= reach))
    pairs = stored(pairs.select("u", "u_print", "v", "v_print", F.col("u_n").alias("n")), "pairs")
    edges = stored(verified(pairs, rows, similarity, shingle), "edges")
    comps = stored(connected(edges), "joined")

    def settled(frame: DataFrame) -> DataFrame:
        return frame.join(comps, F.col("id") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "id")).drop("node", "root")

    def candidates(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, n, comp = (group.column(c).to_numpy() for c in ("id", "n", "comp"))
        root = within_reach(_points(group.column("fp")), n, comp, group.column("main")[0].as_py(), similarity, reach)
        at = np.flatnonzero(root != np.arange(len(ids)))
        return table("u long, v long", ids[at], ids[root[at]])

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        sets = Sets([np.unique(shingle_hashes(t, shingle)) for t in group.column("text").to_pylist()])
        ids, comp = group.column("id").to_numpy(), group.column("comp").to_numpy()
        found = exact_links(ids, comp, group.column("main")[0].as_py(), _points(group.column("fp")), sets, similarity, reach)
        return table("u long, v long", [a for a, _ in found], [b for _, b in found])

    # first only which shards hold more than one component, then the fingerprints for these; shards of two are done
    tasks = in_tasks(settled(shards.where("sets > 2").select("block", "id")).withColumn("load", F.lit(1).cast("long")), POINTS)
    near = stored(grouped(tasks.join(facts, "id"), TASK, candidates, "u long, v long").distinct(), "near")
    groups = stored(connected(near), "groups")
    blocks = groups.select(F.col("node").alias("id"), F.col("root").alias("block")).unionByName(groups.select(F.col("root").alias("id"), F.col("root").alias("block")).distinct())
    tasks = in_tasks(settled(blocks.join(facts, "id")).withColumn("load", F.col("n") + EACH), SHARE)
    texts = tasks.join(rows.withColumnRenamed("doc_id", "id"), ["id", "print"])
    return edges.unionByName(grouped(texts, TASK, compare, "u long, v long"))


def first_of_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they were, without near copies of a row with a smaller id.

    Near copies have sets of five-word shingles whose Jaccard similarity is 0.8 or more, compared exactly; groups are
    closed under links. Of equal sets one is compared. Null and blank texts are copies of each other.
    Rows with a null id are kept and not compared; rows of one id count as one document, kept or gone together. Columns
    may have any name but that of the id twice. An empty table gives no row. A pair of similarity 0.8 is not looked
    at when no band or too few fingerprint bits agree, less than once in a thousand times; a more similar one still less.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).where("doc_id IS NOT NULL").withColumn("print", F.xxhash64("text"))
    found = stored(shingled(rows, shingle), "shingles")
    first = F.min(F.struct("doc_id", "print")).alias("first")
    classes = found.groupBy("digest").agg(first, *[F.first(c).alias(c) for c in ("n", "fp", "bands")])
    classes = stored(classes.select("digest", F.col("first.doc_id").alias("id"), F.col("first.print").alias("print"), "n", "fp", "bands"), "sets")
    copies = found.select("doc_id", "digest").join(classes.select("digest", "id"), "digest").where("doc_id > id").select(F.col("id").alias("u"), F.col("doc_id").alias("v"))
    gone = connected(similar_edges(rows, classes, similarity, shingle).unionByName(copies))
    left = fresh_name(docs)
    return docs.join(gone.select(F.col("node").alias(left)), F.col(f"`{id_col}`") == F.col(left), "left_anti")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
