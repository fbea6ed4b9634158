"""Sources of transcript lines: session files, and adapters from other tables.

Listing opens no file. Files up to LARGE bytes are read as one row each; larger ones in byte ranges, a row for each line,
with line numbers from a running sum of the ranges' line counts, so that no row ever holds such a file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes over which a file is read in ranges; files up to which a read names each of them; bytes hashed at a time.
LARGE, NAMED, CHUNK = 256 << 20, 10_000, 8 << 20
LINES = ("source_id", "path", "project_dir", "line_no", "line")


@dataclass(frozen=True)
class Source:
    """A root folder of session files, and the tag that its rows carry."""

    id: str
    path: str
    kind: str = "jsonl"
    enabled: bool = True


def is_session_file(path: F.Column) -> F.Column:
    """Ends with .jsonl, isn't a dotfile, and lies in no companion folder."""
    return path.endswith(".jsonl") & ~path.rlike(r"/\.[^/]*$") & ~path.contains("/subagents/") & ~path.contains("/tool-results/")


def _reader(spark: SparkSession):
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl")


def list_files(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """source_id, source_ord, path, modified, length of all session files; none is opened.

    Sources that are off or of a kind without adapter are passed over. Spark's listing also passes over
    files and folders whose names start with _ or a dot.
    """
    out = None
    for order, s in enumerate(sources):
        if s.enabled and s.kind in ADAPTERS:
            files = _reader(spark).option("recursiveFileLookup", True).load(s.path)
            part = files.where(is_session_file(F.col("path"))).select(F.lit(s.id).alias("source_id"), F.lit(order).alias("source_ord"), "path", F.col("modificationTime").alias("modified"), "length")
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "source_id string, source_ord int, path string, modified timestamp, length long")


def read_files(spark: SparkSession, sources: list[Source], wanted: DataFrame) -> DataFrame:
    """The listed files of wanted (path, modified, source_id, source_ord, length) with content and file_hash, a row for each.

    Up to NAMED files are read by their names, so no other file is opened. Of more, the sources are scanned from the
    oldest wanted file on.
    """
    facts = wanted.select("path", "source_id", "source_ord", "modified", "length")
    named = [r.path for r in facts.select("path").distinct().limit(NAMED + 1).collect()]
    if not named:
        return facts.withColumns({"content": F.lit(None).cast("binary"), "file_hash": F.lit(None).cast("string")})
    if len(named) <= NAMED:
        found = _reader(spark).load([_escaped(p) for p in named])
    else:
        oldest, found = facts.agg(F.min("modified")).first()[0], None
        for path in sorted({s.path for s in sources if s.enabled and s.kind in ADAPTERS}):
            part = _reader(spark).option("recursiveFileLookup", True).load(path).where(F.col("modificationTime") >= F.lit(oldest))
            found = part if found is None else found.unionByName(part)
    return facts.join(found.select("path", "content").dropDuplicates(["path"]) if len(named) > NAMED else found.select("path", "content"), "path").withColumn("file_hash", F.sha2("content", 256))


def _escaped(path: str) -> str:
    """A path that stands for itself where patterns are read."""
    return "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in path)


def scan_files(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """source_id, source_ord, path, modified, length, content, file_hash of all session files, as one scan."""
    out = None
    for order, s in enumerate(sources):
        if s.enabled and s.kind in ADAPTERS:
            files = _reader(spark).option("recursiveFileLookup", True).load(s.path).where(is_session_file(F.col("path")))
            part = files.select(F.lit(s.id).alias("source_id"), F.lit(order).alias("source_ord"), "path", F.col("modificationTime").alias("modified"), "length", "content", F.sha2("content", 256).alias("file_hash"))
            out = part if out is None else out.unionByName(part)
    return out


def hashed(files: DataFrame) -> DataFrame:
    """path and file_hash of files of any size: a task streams each file in chunks of CHUNK bytes."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(quote(path if "://" in path else path.replace(":/", ":///", 1), safe="/:@"))
                digest = hashlib.sha256()
                with store.open_input_stream(at) as data:
                    while chunk := data.read(CHUNK):
                        digest.update(chunk)
                out.append((path, digest.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["path", "file_hash"])

    return files.select("path").distinct().mapInArrow(run, "path string, file_hash string")


def range_lines(spark: SparkSession, files: DataFrame, work: str) -> DataFrame:
    """The lines of files(path, source_id), read in byte ranges (at most spark.sql.files.maxPartitionBytes each).

    The same rows as split_lines gives, but for a blank one behind a file's last line end, and a byte order mark, which goes. The
    lines are written to work once, so that a range's count and its lines come from the same read.
    """
    named = {r.path: r.source_id for r in files.select("path", "source_id").collect()}
    if not named:
        return spark.createDataFrame([], "source_id string, path string, project_dir string, line_no int, line string")
    # the reader's own name of a file is an escaped URI
    plain = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^(\\w+):///", "$1:/")
    rows = spark.read.text([_escaped(p) for p in named]).select(plain.alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.make_valid_utf8("value").alias("line"))
    rows.write.parquet(work)
    rows = spark.read.schema(rows.schema).parquet(work)
    ranges = rows.groupBy("path", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("before", before).join(files.select("path", "source_id").distinct(), "path").select("path", "start", "first", "before", "source_id")
    numbered = rows.join(ranges, ["path", "start"])
    return numbered.select("source_id", "path", _folder().alias("project_dir"), (F.col("before") + F.col("at") - F.col("first") + 1).cast("int").alias("line_no"), "line")


def _folder() -> F.Column:
    return F.element_at(F.split("path", "/"), -2)


def split_lines(files: DataFrame) -> DataFrame:
    """One row for each line of each file. Lines end at CRLF, LF or CR only; bad UTF-8 is replaced."""
    text = F.expr("make_valid_utf8(cast(content AS string))")
    rows = files.withColumn("project_dir", _folder()).select("source_id", "path", "project_dir", F.posexplode(F.split(text, "\r\n|\n|\r")).alias("pos", "line"))
    return rows.select("source_id", "path", "project_dir", (F.col("pos") + 1).alias("line_no"), "line")


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"jsonl": split_lines}


def register_adapter(kind: str, to_lines: Callable[[DataFrame], DataFrame]) -> None:
    """Adds a source kind: a function from scanned files to the columns of LINES."""
    ADAPTERS[kind] = to_lines


def _line(**fields) -> F.Column:
    return F.to_json(F.struct(*[(v if isinstance(v, F.Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


def _text_message(text: F.Column) -> F.Column:
    return F.struct(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"))


def lines_of_conversations(conversations: DataFrame) -> DataFrame:
    """A session for each conv_id; user and assistant turns become text blocks, system turns meta lines."""
    c = conversations
    stamp = F.date_format(F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id % 28 AS int), cast(turn AS int), 0)"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    sid = F.format_string("c%08d-conversation", "conv_id")
    line = _line(
        type=F.when(F.col("role") == "assistant", "assistant").otherwise("user"), isMeta=F.when(F.col("role") == "system", True), sessionId=sid, uuid=F.format_string("m%d-%d", "conv_id", "turn"), timestamp=stamp,
        cwd=F.format_string("/c/talk%d", F.col("conv_id") % 5), gitBranch=F.format_string("b%d", F.col("conv_id") % 3), message=_text_message(F.coalesce("text", F.lit(""))),
    )
    path = F.concat(F.lit("/talks/"), sid, F.lit(".jsonl"))
    return c.select(F.lit("talks").alias("source_id"), path.alias("path"), F.lit("talks").alias("project_dir"), (F.col("turn") + 1).cast("int").alias("line_no"), line.alias("line"))


def lines_of_events(events: DataFrame) -> DataFrame:
    """A session for each user and day: a user line, then an assistant line with one tool call for each event."""
    day = F.to_date("ts")
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    e = events.withColumn("day", day).withColumn("n", F.row_number().over(w) + 1)
    sid = F.concat(F.format_string("%06d-", "user_id"), F.date_format("day", "yyyy-MM-dd"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    project = F.format_string("proj%d", F.col("user_id") % 10)
    call = F.struct(F.lit("tool_use").alias("type"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("name"), F.struct(F.concat(F.lit("/f/"), F.col("event_id") % 7).alias("file_path")).alias("input"))
    usage = F.struct(F.floor("value").cast("long").alias("output_tokens"))
    common = {"sessionId": sid, "timestamp": stamp}
    assistant = _line(type="assistant", uuid=F.format_string("e%d", "event_id"), message=F.struct(F.array(call).alias("content"), usage.alias("usage")), **common)
    user = _line(type="user", uuid=F.format_string("u%d", "event_id"), cwd=F.concat(F.lit("/u/"), project), gitBranch=F.format_string("b%d", F.col("user_id") % 3), message=_text_message(F.concat(F.lit("session of user "), F.col("user_id").cast("string"))), **common)
    path = F.concat(F.lit("/events/"), sid, F.lit(".jsonl"))
    rows = e.withColumn("lines", F.when(F.col("n") == 2, F.array(user, assistant)).otherwise(F.array(assistant)))
    rows = rows.select("n", path.alias("path"), project.alias("project_dir"), F.posexplode("lines").alias("i", "line"))
    at = F.when((F.col("n") == 2) & (F.col("i") == 0), 1).otherwise(F.col("n"))
    return rows.select(F.lit("events").alias("source_id"), "path", "project_dir", at.cast("int").alias("line_no"), "line")
