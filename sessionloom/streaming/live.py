"""Streams of transcript lines: session files as they arrive, exactly-once capture, quiet sessions, change feed and live counters."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import Store, first_of_batch, new_rows
from ..plans import parsing
from ..operators.redact import RULES, Rule
from ..plans.ingest import counted, derive, read_records, with_changes
from ..sources.sessions import Source, is_session_file, split_lines

FEED = ("session_uuid", "project_name", "duration_secs", "message_count", "source_id")
FILES = "path string, modificationTime timestamp, length long, content binary"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir. Only a local session without that setting gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-live-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def line_stream(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """A stream of immutable Parquet files: those of a folder, or a single file; all there are in one trigger, or so many."""
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader
    files = spark.read.parquet(path).inputFiles()
    if len(files) == 1 and files[0].rpartition("/")[2] == name:
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def session_files(spark: SparkSession, source: Source, per_trigger: int = 1000) -> DataFrame:
    """The lines of session files as they appear below a source's folder, also in new folders.

    A file is read once, whole, in one batch. Files that still grow belong to `ingest_available`, which takes them in
    when they have been quiet.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", per_trigger).load(source.path)
    return split_lines(files.where(is_session_file(F.col("path"))).withColumn("source_id", F.lit(source.id)))


def capture(stream: DataFrame, store: Store, checkpoint: str, ingest_at: str, trigger: dict | None = None, rules: tuple[Rule, ...] = RULES, scope: str = "strict"):
    """Stores each micro-batch's new sessions with all their tables and appends them to the change feed, once for each batch id.

    Of files with one session in a batch, the first by source and path is taken. A batch's records are parsed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, number = batch.sparkSession, f"{checkpoint}#{batch_id}"
        if store.has_batch(number):
            return
        work = f"{store.path}/_work/{uuid.uuid4().hex}"
        try:
            counted(store)
            read_records(batch, rules, scope).write.parquet(f"{work}/records")
            recs = spark.read.parquet(f"{work}/records")
            folded = parsing.sessions(recs, ingest_at).where("session_uuid IS NOT NULL")
            old = store.read("sessions")
            folded = new_rows(folded, old, "session_uuid") if old is not None else folded
            tables = derive(recs, first_of_batch(folded, order=("source_id", "path")), rules, scope)
            store.publish(with_changes(store, tables, f"{work}/changes") | {"feed": tables["sessions"].select(*FEED)}, number)
            store.tidy()
        finally:
            fs, path = store._fs(work)
            fs.delete(path, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def backfill_then_follow(stream, store: Store, checkpoint: str, ingest_at: str, every: str = "5 seconds"):
    """Takes in all that is there, and then goes on with what arrives, over one checkpoint. stream makes the stream."""
    capture(stream(), store, checkpoint, ingest_at).awaitTermination()
    return capture(stream(), store, checkpoint, ingest_at, {"processingTime": every})


def once_per_session(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Of events with ts and session_uuid, the first of each session within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_uuid"])


def quiet_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of events of a user that a quiet gap ends: start, end and number.

    In append mode a run is given when the watermark has passed its end, in complete mode the open ones too.
    """
    rows = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return rows.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


ENDED = "session_uuid string, started timestamp, ended timestamp, events long, reason string"
RUNS = "starts array<long>, ends array<long>, counts array<long>, given boolean"


def ended_sessions(stream: DataFrame, quiet: float = 1800, max_wait: float = 6 * 3600, late: str = "1 hour", remember: float | None = None) -> DataFrame:
    """Each session of events (ts, session_uuid) once, when it ends: by quiet seconds without an event, or max_wait after the first.

    A key's state holds the runs that its events form so far, as bounds and counts, and one timer, which each event
    sets anew. The first run in event time is what is given, so neither the number of triggers nor the order of events
    within the watermark changes it. Of a session that was given a mark stays, so that later events never give it again,
    whatever the gap; with remember, the mark goes that many seconds after the end. Rows without ts or session count for
    nothing. reason is quiet or max_wait; a session that is still open when the stream stops waits in the checkpoint.
    """
    gap, most = int(quiet * 1e6), int(max_wait * 1e6)
    keep = None if remember is None else int(remember * 1e3)

    def merge(parts: list[list[int]]) -> list[list[int]]:
        out: list[list[int]] = []
        for start, end, n in sorted(parts):
            if out and start - out[-1][1] <= gap:
                out[-1] = [out[-1][0], max(end, out[-1][1]), out[-1][2] + n]
            else:
                out.append([start, end, n])
        return out

    def step(key, frames, state):
        if state.hasTimedOut and state.get[3]:
            state.remove()
            return
        starts, ends, counts, given = state.get if state.exists else ([], [], [], False)
        if given:
            # what comes in doesn't count, and puts no timer off
            if keep is not None:
                state.setTimeoutTimestamp(max(ends[0] + keep, state.getCurrentWatermarkMs() + 1))
            return
        now = state.getCurrentWatermarkMs()
        parts = [list(r) for r in zip(starts, ends, counts, strict=True)] + [[int(t.value // 1000)] * 2 + [1] for f in frames for t in f["ts"]]
        first = min(p[0] for p in parts)
        parts = [p for p in parts if p[0] <= first + most]
        runs = merge(parts)
        _, end, n = runs[0]
        deadline = -(-min(end + gap, first + most) // 1000)
        if deadline < now:
            reason = "quiet" if end + gap <= first + most else "max_wait"
            yield pd.DataFrame({"session_uuid": [key[0]], "started": pd.to_datetime([first], unit="us"), "ended": pd.to_datetime([end], unit="us"), "events": [n], "reason": [reason]})
            state.update(([], [deadline], [], True))
            if keep is not None:
                state.setTimeoutTimestamp(max(deadline + keep, now + 1))
            return
        # as long as an earlier first event could come, and with it an earlier end of the wait, events stay apart
        state.update(tuple(map(list, zip(*(runs if now * 1000 >= first else parts), strict=True))) + (False,))
        state.setTimeoutTimestamp(max(deadline, now + 1))

    rows = stream.where("ts IS NOT NULL AND session_uuid IS NOT NULL").select("ts", "session_uuid").withWatermark("ts", late)
    return rows.groupBy("session_uuid").applyInPandasWithState(step, ENDED, RUNS, "append", "EventTimeTimeout")


PARTS = "session_uuid string, start long, end long, n long, started long, deadline long, batch long, given boolean"


def capture_ended(stream: DataFrame, root: str, quiet: float = 1800, max_wait: float = 6 * 3600, late: float = 3600, remember: float | None = None, trigger: dict | None = None):
    """The sessions of `ended_sessions`, as plain aggregates and windows over each micro-batch, for very many sessions.

    Python sees no session: what a key's state holds there is a few rows here, written anew by each batch for the
    sessions that are open, and the rows of given sessions are their marks. The watermark is the latest event of all batches
    less late seconds; events of a batch count when they come after the one before it, and sessions are given by the one
    after it. All of a batch lies in folders of its number, of which a batch that runs again writes the same once more.
    `ended_rows` reads what was given.
    """
    spark, gap, most, keep = stream.sparkSession, int(quiet * 1e6), int(max_wait * 1e6), None if remember is None else int(remember * 1e3)
    session, row_order = Window.partitionBy("session_uuid"), Window.partitionBy("session_uuid").orderBy("start", "end")
    parts, marks = f"{root}/parts", f"{root}/watermarks"
    spark.createDataFrame([], PARTS).drop("batch").write.mode("overwrite").partitionBy("given").parquet(f"{parts}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.where("ts IS NOT NULL AND session_uuid IS NOT NULL").select("session_uuid", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"))
        before = spark.read.schema("ms long").parquet(f"{marks}/{number - 1}").first()[0] if number else None
        last = rows.agg(F.max("start")).first()[0]
        now = max((ms for ms in (before, None if last is None else last // 1000 - int(late * 1e3)) if ms is not None), default=None)
        if before is not None:
            rows = rows.where(F.col("start") > before * 1000)
        rows = rows.groupBy("session_uuid", "start").agg(F.count("*").alias("n")).withColumn("end", F.col("start"))
        if number:
            held = spark.read.schema(PARTS).parquet(parts)
            known = held.where(F.col("given") & (F.col("batch") < number) & (F.lit(True) if keep is None or before is None else F.col("deadline") + keep >= before))
            rows = rows.join(known.select("session_uuid"), "session_uuid", "left_anti")
            rows = rows.unionByName(held.where(~F.col("given") & (F.col("batch") == number - 1)).select("session_uuid", "start", "n", "end"))
        rows = rows.withColumn("started", F.min("start").over(session)).where(F.col("start") <= F.col("started") + most)
        earlier = F.max("end").over(row_order.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("opens", F.coalesce(F.col("start") - earlier > gap, F.lit(False)).cast("int"))
        rows = rows.withColumn("run", F.sum("opens").over(row_order.rowsBetween(Window.unboundedPreceding, 0)))
        # as long as an earlier first event could come, and with it an earlier end of the wait, events stay apart
        apart = F.when(F.lit(now).cast("long") * 1000 >= F.col("started"), F.lit(None)).otherwise(F.col("start"))
        first_end = F.max(F.when(F.col("run") == 0, F.col("end"))).over(session)
        rows = rows.withColumn("deadline", F.ceil(F.least(first_end + gap, F.col("started") + most) / 1000).cast("long"))
        runs = rows.groupBy("session_uuid", "started", "deadline", "run", apart.alias("apart")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
        runs = runs.withColumn("given", F.coalesce(F.col("deadline") < F.lit(now).cast("long"), F.lit(False))).where(~F.col("given") | (F.col("run") == 0))
        runs.select("session_uuid", "start", "end", "n", "started", "deadline", "given").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("given").parquet(f"{parts}/batch={number}")
        spark.range(1).select(F.lit(now).cast("long").alias("ms")).write.mode("overwrite").parquet(f"{marks}/{number}")
        # the state before the last one can't be asked for any more
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{parts}/batch={number - 2}/given=false")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.select("ts", "session_uuid").writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def ended_rows(spark: SparkSession, root: str, quiet: float = 1800, max_wait: float = 6 * 3600) -> DataFrame:
    """session_uuid, started, ended, events, reason of the sessions that `capture_ended` has given below root, under the same times."""
    rows = spark.read.schema(PARTS).parquet(f"{root}/parts").where("given")
    reason = F.when(F.col("end") + int(quiet * 1e6) <= F.col("started") + int(max_wait * 1e6), "quiet").otherwise("max_wait")
    return rows.select("session_uuid", F.timestamp_micros("started").alias("started"), F.timestamp_micros("end").alias("ended"), F.col("n").alias("events"), reason.alias("reason"))


def live_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total_value"))


def run_to_rows(stream: DataFrame, mode: str) -> DataFrame:
    """All that is available now, as a table, by way of files: appended rows, or the whole result as of the last batch."""
    spark = stream.sparkSession
    root = shared_folder(spark, "live")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{root}/rows").awaitTermination()
    else:
        writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/rows")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
