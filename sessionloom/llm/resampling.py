"""Importance resampling towards a target distribution: array-scored weights, ranks by parallel sorting by regular sampling."""

from __future__ import annotations

import hashlib
import math
import re
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import CRC_TABLE, crc32_sql, lower_sql, partitions, pick, read, spans, stored, table

BUCKETS = 10_000
#: Bytes of a text whose words are held at a time.
PIECE = 1 << 20
#: Regular samples that come to the driver for one segment, and in all (besides the first row of each run).
SAMPLES, MOST_SAMPLES = 64, 1 << 18
#: Bits of a row's number within its partition, as monotonically_increasing_id has them.
ROW_BITS = 33

_words = re.compile(rb"[0-9a-z\x80-\xff]+").findall
_gap = re.compile(rb"[^0-9a-z\x80-\xff]").search

SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def buckets(raw: bytes, count: int = BUCKETS):
    """(words, buckets of their features) for each piece of a text: words and pairs of neighbours, also across pieces.

    The checksum of "a b" goes on from that of "a ", so no pair is ever put together as text.
    """
    raw, at, last = raw.lower(), 0, None
    while at < len(raw):
        stop = len(raw)
        if stop - at > PIECE and (gap := _gap(raw, at + PIECE)):
            stop = gap.start()
        words = _words(raw, at, stop)
        at = stop
        if not words:
            continue
        singles = list(map(crc32, words))
        spaced = map(crc32, repeat(b" "), ([] if last is None else [last]) + singles)
        pairs = map(crc32, words if last is not None else words[1:], spaced)
        last = singles[-1]
        yield len(words), np.fromiter((*singles, *pairs), np.uint32) % np.uint32(count)


def _raw(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def bucket_counts(texts: DataFrame, text_col: str = "text", count: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs over all texts. A task sums its own rows first and sends at most a row for each bucket."""

    def counted(batches):
        found = np.zeros(count, np.int64)
        for batch in batches:
            for raw in _raw(batch.column(0)):
                for _, hits in buckets(raw, count):
                    found += np.bincount(hits, minlength=count)
        used = np.flatnonzero(found)
        yield from table("bucket long, n long", used, found[used]).to_batches()

    sums = pick(texts, text=text_col).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(count, np.int64)
    for bucket, n in sums:
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, 1000 times the logarithm of the target's share over the source's, add-one smoothed, floored."""
    have, want = float(source.sum()) + len(source), float(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((t + 1) * have / ((s + 1) * want))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int, seed: int) -> int:
    """A standard Gumbel value from the id, in thousandths: the highest sums of weight and noise are a draw without replacement."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, features, mean gain and score of each document, by one look-up in the array of gains for each feature."""

    def score(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc_id, raw in zip(ids, _raw(batch.column(1)), strict=True):
                n_words = n_features = total = 0
                for n, hits in buckets(raw, len(gain)):
                    n_words, n_features, total = n_words + n, n_features + len(hits), total + int(gain[hits].sum())
                weight = total // n_features if n_features else 0
                rows.append((doc_id, n_words, n_features, weight, None if doc_id is None else weight + noise(doc_id, seed)))
            if rows:
                yield from table(SCORED, *map(list, zip(*rows, strict=True))).to_batches()

    return pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(score, SCORED)


def _keys(scores, ids, features, at) -> np.ndarray:
    """Byte strings in the order of falling score, then rising id, features and row number."""
    parts = [~np.asarray(scores, np.int64), *(np.asarray(x, np.int64) for x in (ids, features, at))]
    flipped = np.stack([p.view(np.uint64) ^ np.uint64(1 << 63) for p in parts], axis=1)
    return flipped.astype(">u8").view("S32").ravel()


def ranked(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows (doc_id, n_features, score, at, ...) with rank 1, 2, 3... by falling score, then id, and how many they are.

    Parallel sorting by regular sampling. at is a row's number: the partition that it was sorted in, and its place there.
    Rows of each run at regular steps go to the driver (at most MOST_SAMPLES and one a run); from these come the
    splitters of as many segments as there are shuffle partitions. Each segment goes to one task, which merges the parts of
    the runs, and a row's rank is its place there plus the rows of the segments before. Row numbers break ties, so
    rows that share id and score are parted like others.
    """
    spark, parts = rows.sparkSession, partitions(rows.sparkSession)
    n = rows.count()
    step = max(1, n // min(SAMPLES * parts, MOST_SAMPLES))
    some = rows.where(F.col("at").bitwiseAND((1 << ROW_BITS) - 1) % step == 0).select("score", "doc_id", "n_features", "at").toArrow()
    samples = np.sort(_keys(*[some.column(i).to_numpy() for i in range(4)]))
    splitters = samples[np.arange(1, parts) * len(samples) // parts] if len(samples) else samples
    schema = StructType([*rows.schema, StructField("segment", IntegerType())])

    def segments(batches):
        for batch in batches:
            keys = _keys(*[batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("score", "doc_id", "n_features", "at")])
            yield batch.append_column("segment", pa.array(np.searchsorted(splitters, keys, side="right"), pa.int32()))

    dealt = rows.mapInArrow(segments, schema).repartitionById(parts, "segment")
    merged = stored(dealt.sortWithinPartitions(F.col("score").desc(), "doc_id", "n_features", "at").withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1)), "segments")
    sizes = sorted(merged.groupBy("segment").agg(F.count("*").alias("n")).collect())
    starts = spans(np.array([n for _, n in sizes], np.int64)).tolist()
    offsets = spark.createDataFrame([(r.segment, start) for r, start in zip(sizes, starts, strict=False)], "segment int, earlier long")
    return merged.join(F.broadcast(offsets), "segment").withColumn("rank", F.col("earlier") + F.col("place") + 1).drop("segment", "place", "earlier"), n


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null unless it is drawn.

    Bucket counts of both tables cover all texts; gains are one array of BUCKETS numbers. Of the documents with at least
    least_words words, percent in a hundred are drawn. Null and empty texts have no features, weight 0 and are never
    drawn. A row whose id is null counts for the buckets, but has no score and isn't drawn. Rows that share an id are
    documents of their own. Empty tables give no rows, and an empty target gains that come from smoothing alone.
    Other columns don't matter.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    took_part = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    runs = scored(docs, gain, seed, id_col, text_col).withColumn("in", took_part)
    runs = stored(runs.sortWithinPartitions(F.col("in").desc(), F.col("score").desc(), "doc_id", "n_features").withColumn("at", F.monotonically_increasing_id()), "runs")
    names = ("doc_id", "n_features", "weight", "score")
    order, n = ranked(runs.where("in").select(*names, "at"))
    drawn = F.when(F.col("rank") <= percent * n // 100, F.col("rank"))
    return order.select(*names, drawn.alias("rank")).unionByName(runs.where("not `in`").select(*names, F.lit(None).cast("long").alias("rank")))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_FEATURES = """SELECT {key} AS key, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS feature
  FROM (SELECT {key}, regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM {table})"""
OP11_SQL = f"""WITH crc AS MATERIALIZED {CRC_TABLE},
s_features AS MATERIALIZED (SELECT key, feature, count(*) AS n FROM ({_FEATURES.format(key="doc_id", low=lower_sql("text"), table="documents")}) GROUP BY ALL),
t_features AS MATERIALIZED (SELECT key, feature, count(*) AS n FROM ({_FEATURES.format(key="item_id", low=lower_sql("text"), table="benchmark")}) GROUP BY ALL),
bucketed AS MATERIALIZED (SELECT feature, ({crc32_sql("feature")} % 10000)::BIGINT AS bucket
  FROM (SELECT feature FROM s_features UNION SELECT feature FROM t_features), crc),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM s_features JOIN bucketed USING (feature) GROUP BY 1),
t AS (SELECT bucket, sum(n)::BIGINT AS t FROM t_features JOIN bucketed USING (feature) GROUP BY 1),
sums AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE + 10000 AS have, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000 AS want),
gains AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * have / ((s + 1) * want))) AS gain FROM s LEFT JOIN t USING (bucket), sums),
means AS (SELECT key AS doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS mean, sum(n) FILTER (feature NOT LIKE '% %')::BIGINT AS n_words
  FROM s_features JOIN bucketed USING (feature) JOIN gains USING (bucket) GROUP BY 1),
scores AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(mean, 0) AS weight, coalesce(n_words, 0) AS n_words,
  coalesce(mean, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN means USING (doc_id)),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scores WHERE n_words >= 20)
SELECT scores.doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scores LEFT JOIN ranks USING (doc_id)"""
