"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent in a local session, as in tests, one is made and set. On a cluster
    its absence is an error: each executor would write to a disk of its own.
    """
    root = spark.conf.get(SETTING, None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(SETTING, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    The folder stays as long as results may read it; it goes with the shared folder of the application."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder below the shared one that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_keys(spark: SparkSession, count: int, parts: int) -> np.ndarray:
    """So many numbers that an exchange by their hash into parts deals evenly: no part gets two more than another.

    They are taken from the first numbers whose hashes fall into each part."""
    some = spark.range(16 * max(count, parts)).select("id", F.expr(f"pmod(hash(id), {parts})").alias("part"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    found = some.withColumn("place", place).where(F.col("place") <= -(-count // parts)).orderBy("place", "part").limit(count).collect()
    if len(found) < count:
        raise RuntimeError(f"only {len(found)} of {count} keys found")
    return np.array([r.id for r in found], np.int64)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the operator's own names; others can't clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def fresh_name(df: DataFrame, name: str = "other_side") -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


#: Arrow types of the types named in the operators' schemas.
KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def table(schema: str, *columns) -> pa.Table:
    """An Arrow table of columns in the order of a schema text such as "a long, b binary"; nulls stay null."""
    names, kinds = zip(*[c.split() for c in schema.split(", ")], strict=True)
    return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, KINDS[k]) for c, k in zip(columns or [[]] * len(names), kinds, strict=True)], names=list(names))


def grouped(df: DataFrame, keys: tuple[str, ...], run, schema: str) -> DataFrame:
    """run(rows) over the rows of each value of the keys (numbers or booleans, no nulls), as Arrow tables.

    As applyInArrow, but without a stream for each group: for very many small groups.
    """

    def stream(batches):
        held, last = [], None

        def close():
            yield from run(pa.concat_tables(held)).to_batches() if held else ()

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            values = np.column_stack([rows.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
            cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(values)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if last is None or (values[a] != last).any():
                    yield from close()
                    held, last = [], values[a]
                held.append(rows.slice(a, b - a))
        yield from close()

    return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def merged(labels: np.ndarray, at: np.ndarray) -> None:
    """Gives the points at these places the least of their labels, and so all others that have one of them."""
    known = np.unique(labels[at])
    if len(known) > 1:
        labels[np.isin(labels, known)] = known[0]


def spans(lengths: np.ndarray) -> np.ndarray:
    """Offsets 0, l0, l0+l1, ... of consecutive pieces."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


#: For DuckDB: a table of one row with the 256 remainders of the CRC-32 polynomial.
CRC_TABLE = "(SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END, n::UBIGINT)) AS remainders)"
CAPITALS, SMALL = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes, beside CRC_TABLE."""
    byte = f"('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::UBIGINT"
    return f"xor(4294967295::UBIGINT, list_reduce(list_transform(range(0, octet_length(encode({text}))), lambda i: {byte}), lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255)::INT + 1]), 4294967295::UBIGINT))"


def lower_sql(text: str) -> str:
    """DuckDB SQL that lower-cases A-Z and nothing else."""
    return f"translate({text}, '{CAPITALS}', '{SMALL}')"
