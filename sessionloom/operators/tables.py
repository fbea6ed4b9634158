"""Deduplication, stored tables and their upkeep."""

from __future__ import annotations

import json
import math
import uuid

import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def first_of_batch(files: DataFrame, key: str = "session_uuid", order: tuple[str, ...] = ("source_ord", "path")) -> DataFrame:
    """Of rows with one key, the first by order. Minima are taken in part before the exchange, so a key that very many
    rows share is no task of its own. Rows with a null key count as one key's."""
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in files.columns]), F.struct(*order))
    return files.groupBy(F.col(key).alias("_key")).agg(row.alias("_row")).select("_row.*")


def new_rows(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of the batch whose key isn't stored yet. Rows with a null key are new."""
    return batch.join(stored.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def known_rows(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return batch.join(stored.select(key), key, "left_semi")


def by_prefix(sessions: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Up to limit sessions whose id starts with prefix, with outcome none, found or ambiguous."""
    hits = sessions.where(F.col("session_uuid").startswith(prefix)).orderBy("session_uuid").limit(limit)
    return hits.withColumn("outcome", F.when(F.count("*").over(Window.partitionBy(F.lit(1))) > 1, "ambiguous").otherwise("found"))


class Conflict(RuntimeError):
    """Another writer published the version that this one was about to."""


class Store:
    """Parquet tables below one folder, each dealt into buckets of its key's hash.

    A batch first writes all its tables to folders of its own, and then one new small file that names the current
    folders of every bucket, put in place by a rename. Readers see all of a batch or nothing; a batch that fails
    leaves no trace but unread files; of two writers the second one fails. Replacing or
    deleting sessions writes only the buckets of these sessions anew; a table that has grown gets more buckets, of which each is
    split by the next bit of the hash, so that what one session costs doesn't grow with the table. Postings lie in buckets of terms instead and are
    not rewritten: a posting counts only if doc_stats still names its batch for the session.
    """

    KEYS = {"postings": "term", "impacts": "term", "terms": "token", "term_counts": "term", "term_cells": "term", "projects": "project_name", "ingest_log": "path_key"}
    #: Folders of a bucket, over which it is written as one again; old versions of the state kept.
    PARTS, VERSIONS = 16, 20
    #: Batch ids kept; of ids such as "stream#7" the highest number of each stream counts, whatever their number.
    BATCHES = 1000
    #: Bytes that the buckets of a table hold on average before some are split.
    BUCKET_BYTES = 128 << 20
    #: Tables of counts that add up: what they are counted for, and what is summed when buckets are written anew.
    SUMMED = {"term_counts": (("term",), ("n", "tokens")), "term_cells": (("term", "cell"), ("n",))}
    #: Tables whose rows name their batch.
    BATCHED = ("postings", "impacts", "doc_stats")

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _listed(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def current(self) -> dict:
        """The state: version, batches, and of each table its schema and the folders of its buckets."""
        versions = [n for n in self._listed(f"{self.path}/_state") if n.endswith(".json") and not n.startswith((".", "_"))]
        if not versions:
            return {"version": 0, "buckets": self.buckets, "batches": [], "tables": {}}
        return self._state(versions[-1])

    def _state(self, name: str) -> dict:
        fs, at = self._fs(f"{self.path}/_state/{name}")
        stream = fs.open(at)
        try:
            state = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        for entry in state["tables"].values():
            for key, value in self._start(state).items():
                entry.setdefault(key, value)
        return state

    def _start(self, state: dict) -> dict:
        """How a new table is dealt: by the hash modulo `modulus`, the first `split` buckets by the next bit too."""
        return {"modulus": state.get("buckets", self.buckets), "split": 0, "bytes": {}}

    def _commit(self, state: dict) -> None:
        state = state | {"version": state["version"] + 1}
        for entry in state["tables"].values():
            entry["bytes"] = {p: entry["bytes"].get(p, 0) for parts in entry["buckets"].values() for p in parts}
        fs, target = self._fs(f"{self.path}/_state/{state['version']:012d}.json")
        _, part = self._fs(f"{self.path}/_state/_{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        if fs.exists(target) or not fs.rename(part, target):
            fs.delete(part, False)
            raise Conflict(f"another batch published version {state['version']} first")
        for name in [n for n in self._listed(f"{self.path}/_state") if n.endswith(".json")][: -self.VERSIONS]:
            fs.delete(self._fs(f"{self.path}/_state/{name}")[1], False)

    def key(self, table: str) -> str:
        return self.KEYS.get(table, "session_uuid")

    @staticmethod
    def _bucket(entry: dict, column: str) -> F.Column:
        h, m = f"xxhash64(`{column}`)", entry["modulus"]
        return F.expr(f"if(pmod({h}, {m}) < {entry['split']}, pmod({h}, {2 * m}), pmod({h}, {m}))").cast("int")

    @staticmethod
    def _bucket_of(entry: dict, key: str) -> str:
        """The bucket of one text, as _bucket has it."""
        h, m = xxhash.xxh64_intdigest(key.encode(), 42), entry["modulus"]
        h -= (1 << 64) if h >> 63 else 0
        return str(h % m if h % m >= entry["split"] else h % (2 * m))

    def _load(self, entry: dict, buckets: list[str] | None = None) -> DataFrame:
        paths = [p for b, parts in entry["buckets"].items() if buckets is None or b in buckets for p in parts]
        schema = StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _touched(self, entry: dict, keys: DataFrame, key: str) -> list[str]:
        return [str(r.b) for r in keys.select(self._bucket(entry, key).alias("b")).distinct().collect()]

    def read(self, table: str, keys: list[str] | None = None, state: dict | None = None) -> DataFrame | None:
        """A table, or only the buckets that hold these keys; None if it was never written. Several reads of one state agree."""
        entry = (state or self.current())["tables"].get(table)
        if entry is None:
            return None
        if keys is None:
            return self._load(entry)
        return self._load(entry, sorted({self._bucket_of(entry, k) for k in keys})).where(F.col(self.key(table)).isin(*keys))

    def near(self, table: str, keys: DataFrame, state: dict | None = None) -> DataFrame | None:
        """The rows of a table whose key is among those of a table of keys, from the buckets of these only."""
        entry, key = (state or self.current())["tables"].get(table), self.key(table)
        if entry is None:
            return None
        keys = keys.select(key).distinct()
        return self._load(entry, self._touched(entry, keys, key)).join(keys.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left_semi")

    def _write(self, entry: dict, table: str, rows: DataFrame) -> dict[str, str]:
        """Writes rows to a new folder; the folder of each bucket that has rows, whose length the entry takes down."""
        target, key = f"{self.path}/{table}/{uuid.uuid4().hex}", self.key(table)
        # a bucket is one task's, unless a key that very many rows share makes it large: then the exchange is split where it is too long
        dealt = rows.withColumn("_bucket", self._bucket(entry, key)).hint("rebalance", "_bucket")
        dealt.sortWithinPartitions("_bucket", key, *[c for c in ("cell",) if c in rows.columns]).write.partitionBy("_bucket").parquet(target)
        new = {n.partition("=")[2]: f"{target}/{n}" for n in self._listed(target) if n.startswith("_bucket=")}
        for path in new.values():
            fs, at = self._fs(path)
            entry["bytes"][path] = fs.getContentSummary(at).getLength()
        return new

    def _add(self, state: dict, table: str, rows: DataFrame, gone: DataFrame | None, like: dict | None = None) -> None:
        """Adds rows to a table of the state; with gone, stored rows with a key of gone go first. A new table may be dealt like another."""
        entry, key = state["tables"].get(table), self.key(table)
        if entry is None:
            schema, buckets = rows.schema, {}
            entry = self._start(state) | {k: like[k] for k in ("modulus", "split") if like}
        else:
            have, buckets = StructType.fromJson(entry["schema"]), {b: list(p) for b, p in entry["buckets"].items()}
            schema = StructType(have.fields + [f for f in rows.schema.fields if f.name not in have.names])
            if gone is not None:
                touched = [b for b in self._touched(entry, gone, key) if b in buckets]
                keys = gone.select(F.col(key).alias("_key")).distinct()
                old = self._load(entry, touched).join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
                rows = old.unionByName(rows, allowMissingColumns=True)
                buckets = {b: p for b, p in buckets.items() if b not in touched}
        for b, path in self._write(entry, table, rows).items():
            buckets.setdefault(b, []).append(path)
        nullable = [dict(f.jsonValue(), nullable=True) for f in schema.fields]
        state["tables"][table] = entry | {"schema": {"type": "struct", "fields": nullable}, "buckets": buckets}

    def publish(self, batch: dict[str, DataFrame], batch_id: str | None = None, replace: bool = False) -> bool:
        """Adds the tables of a batch. A batch id seen before is passed over.

        With replace, stored rows of the sessions of this batch go. Rows of projects always replace those of the
        same project; one without sessions only takes it away.
        """
        state = self.current()
        if self.has_batch(batch_id, state):
            return False
        number = uuid.uuid4().hex
        for table, rows in batch.items():
            if table in self.BATCHED:
                rows = rows.withColumn("batch", F.lit(number))
            if table == "projects":
                self._add(state, table, rows.where("session_count > 0"), rows)
            else:
                self._add(state, table, rows, batch["sessions"] if replace and self.key(table) == "session_uuid" else None)
        self._commit(state | {"batches": self._with_batch(state["batches"], batch_id)})
        return True

    @staticmethod
    def _numbered(batch_id: str) -> tuple[str, int] | None:
        stream, mark, number = batch_id.rpartition("#")
        return (stream, int(number)) if mark and number.isdecimal() else None

    def has_batch(self, batch_id: str | None, state: dict | None = None) -> bool:
        """Whether a batch of this id, or a later one of its stream, was published."""
        if batch_id is None:
            return False
        seen, mine = (state or self.current())["batches"], self._numbered(batch_id)
        return batch_id in seen or mine is not None and any((n := self._numbered(b)) and n[0] == mine[0] and n[1] >= mine[1] for b in seen)

    def _with_batch(self, batches: list[str], batch_id: str | None) -> list[str]:
        if batch_id is None:
            return batches
        mine = self._numbered(batch_id)
        others = [b for b in batches if mine is None or (n := self._numbered(b)) is None or n[0] != mine[0]]
        return [*others[-(self.BATCHES - 1) :], batch_id]

    def tidy(self) -> list[str]:
        """Compacts what has many folders and splits buckets that have grown; another writer's batch in between puts it off."""
        try:
            return self.compact() + self.split()
        except Conflict:
            return []

    def rebuild(self, tables: dict[str, DataFrame]) -> None:
        """Puts whole tables in the place of those of the same names, in one step."""
        state, number = self.current(), uuid.uuid4().hex
        for table, rows in tables.items():
            like = state["tables"].pop(table, None)
            self._add(state, table, rows.withColumn("batch", F.lit(number)) if table in self.BATCHED else rows, None, like)
        self._commit(state)

    def clean(self, older_than: float) -> list[str]:
        """Deletes the folders, last changed before that time (seconds since 1970), that no kept state names; their paths.

        The time must lie before the start of any batch or question still running."""
        used: set[str] = set()
        for name in [n for n in self._listed(f"{self.path}/_state") if n.endswith(".json") and not n.startswith((".", "_"))]:
            state = self._state(name)
            used |= {p.rpartition("/")[0] for t in state["tables"].values() for parts in t["buckets"].values() for p in parts}
        gone = []
        for table in [n for n in self._listed(self.path) if not n.startswith("_")]:
            fs, at = self._fs(f"{self.path}/{table}")
            for found in fs.listStatus(at):
                path = f"{self.path}/{table}/{found.getPath().getName()}"
                if path not in used and found.getModificationTime() < older_than * 1000:
                    fs.delete(found.getPath(), True)
                    gone.append(path)
        return gone

    def delete(self, keys: DataFrame, changes: dict[str, DataFrame] | None = None) -> None:
        """Removes the sessions with these keys from every table in buckets of sessions, and what postings say of them.

        The changes (counts that add up, rows of projects) are published in the same step."""
        state = self.current()
        for table, entry in list(state["tables"].items()):
            if self.key(table) == "session_uuid":
                self._add(state, table, self._load(entry, []), keys)
        for table, rows in (changes or {}).items():
            self._add(state, table, rows.where("session_count > 0") if table == "projects" else rows, rows if table == "projects" else None)
        self._commit(state)

    def _counting(self, state: dict, table: str, rows: DataFrame) -> DataFrame:
        """Rows as they are written anew: without postings that no longer count, counts of one key as one row."""
        if table in ("postings", "impacts") and "doc_stats" in state["tables"]:
            return rows.join(self._load(state["tables"]["doc_stats"]).select("session_uuid", "batch"), ["session_uuid", "batch"], "left_semi")
        if table in self.SUMMED:
            of, sums = self.SUMMED[table]
            return rows.groupBy(*of).agg(*[F.sum(c).alias(c) for c in sums]).where(" OR ".join(f"{c} <> 0" for c in sums))
        return rows

    def compact(self, most: int | None = None) -> list[str]:
        """Writes buckets with more than `most` folders as one folder again."""
        state, done = self.current(), []
        for table, entry in state["tables"].items():
            many = [b for b, parts in entry["buckets"].items() if len(parts) > (self.PARTS if most is None else most)]
            if many:
                new = self._write(entry, table, self._counting(state, table, self._load(entry, many)))
                entry["buckets"] = {b: [new[b]] if b in many else parts for b, parts in entry["buckets"].items() if b not in many or b in new}
                done.append(table)
        if done:
            self._commit(state)
        return done

    def split(self, most: int | None = None) -> list[str]:
        """Splits buckets of the tables whose buckets hold more than `most` bytes on average, until they hold less.

        Buckets are split in their order; one is written as the two (or more) that the next bits of the hash make of it, the others stay.
        """
        state, done = self.current(), []

        def width(entry: dict, bucket: int) -> int:
            return entry["modulus"] * (2 if bucket < entry["split"] or bucket >= entry["modulus"] else 1)

        for table, entry in list(state["tables"].items()):
            wanted = math.ceil(sum(entry["bytes"].get(p, 0) for parts in entry["buckets"].values() for p in parts) / (most or self.BUCKET_BYTES))
            if wanted <= entry["modulus"] + entry["split"]:
                continue
            modulus = entry["modulus"]
            while 2 * modulus <= wanted:
                modulus *= 2
            new = entry | {"modulus": modulus, "split": wanted - modulus}
            moved = [b for b in entry["buckets"] if width(entry, int(b)) != width(new, int(b))]
            kept = {b: parts for b, parts in entry["buckets"].items() if b not in moved}
            if moved:
                kept |= {b: [p] for b, p in self._write(new, table, self._counting(state, table, self._load(entry, moved))).items()}
            state["tables"][table] = new | {"buckets": kept}
            done.append(table)
        if done:
            self._commit(state)
        return done


def orphans(children: DataFrame, sessions: DataFrame) -> DataFrame:
    """Child rows without a session."""
    return children.join(sessions.select("session_uuid"), "session_uuid", "left_anti")
