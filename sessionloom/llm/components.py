"""Connected components by alternating large and small stars, one stored edge table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(u, v) but the roots; root is the component's least node.

    Minima are taken by partial aggregation and written before they are joined back: a join of two plain
    exchanges is one whose large partitions adaptive execution splits, so a node with very many neighbours is no task of its
    own. Rounds grow with the logarithm of the longest chain; what a round wrote is deleted after the next.
    """
    spark, paths = edges.sparkSession, []

    def written(df: DataFrame) -> DataFrame:
        paths.append(scratch(spark, "edges"))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        done = list(paths)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m")))
        large = written(both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = written(large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")))
        done += paths[len(done) :]
        down = large.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = written(down.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        for path in done:
            removed(spark, path)
            paths.remove(path)
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components not closed after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
