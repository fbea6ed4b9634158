"""Markdown documents of sessions, made as one text column from blocks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import export_name, filled, hours_minutes, indented, tool_result_text

#: Wording of the documents. Fixed values.
HEADERS = {"user": "### 👤 User", "assistant": "### 🤖 Claude"}
VERSION = "Claude version"
NOTES = {"thinking": "> _[thinking block omitted]_\n", "image": "> _[image omitted]_\n"}


def block_markdown() -> F.Column:
    kind = F.col("block_type")
    tool = F.concat(F.lit("**🔧 "), F.coalesce("tool_name", F.lit("tool")), F.lit("**\n\n```json\n"), "pretty_input", F.lit("\n```\n"))
    result = tool_result_text(F.col("result"), F.col("result_listed"))
    shown = F.when(result != "", F.concat(F.lit("**↳ tool result**\n\n```\n"), F.substring(result, 1, 4000), F.lit("\n```\n")))
    return F.when(kind == "text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))).when(kind == "thinking", NOTES["thinking"]).when(kind == "image", NOTES["image"]).when(kind == "tool_use", tool).when(kind == "tool_result", shown)


def shown_blocks(blocks: DataFrame) -> DataFrame:
    """The blocks that the export shows, with their Markdown in md. Only tool inputs go through Python."""
    plain = blocks.where("block_type <> 'tool_use'").withColumn("pretty_input", F.lit(None).cast("string"))
    calls = blocks.where("block_type = 'tool_use'").withColumn("pretty_input", indented("tool_input"))
    return plain.unionByName(calls).withColumn("md", block_markdown()).where("md IS NOT NULL")


def markdown(sessions: DataFrame, messages: DataFrame, blocks: DataFrame) -> DataFrame:
    """session_uuid, filename, markdown."""
    parts = shown_blocks(blocks).groupBy("session_uuid", "seq").agg(F.array_sort(F.collect_list(F.struct("block_idx", "md"))).alias("b"))
    role = F.when(F.col("role") == "user", HEADERS["user"]).otherwise(HEADERS["assistant"])
    head = F.concat(role, F.coalesce(F.concat(F.lit("  _"), filled(F.col("timestamp")), F.lit("_")), F.lit("")), F.lit("\n"))
    body = F.transform(F.coalesce("b", F.array().cast("array<struct<block_idx:int,md:string>>")), lambda x: x["md"])
    turns = messages.join(parts, ["session_uuid", "seq"], "left").withColumn("md", F.array_join(F.concat(F.array(head), body, F.array(F.lit("---\n"))), "\n"))
    talk = turns.groupBy("session_uuid").agg(F.array_sort(F.collect_list(F.struct("timestamp", "seq", "md"))).alias("t"))
    quoted = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    item = lambda name, c: F.concat(F.lit(f"- **{name}:** "), c)
    tools = F.when(F.size("tools_used") > 0, F.array_join(F.transform("tools_used", quoted), ", "))
    files = F.when(F.size("files_modified") > 0, F.concat(F.lit("- **Files modified:**\n"), F.array_join(F.transform(F.slice("files_modified", 1, 50), lambda f: F.concat(F.lit("  - `"), f, F.lit("`"))), "\n")))
    meta = F.concat_ws("\n",
        F.concat(F.lit("# "), F.coalesce(filled(F.col("ai_title")), F.lit("Untitled session")), F.lit("\n")), F.lit("## Metadata\n"), item("Project", quoted(F.coalesce("project_name", F.lit("")))),
        item("Branch", quoted(filled(F.col("git_branch")))), item("CWD", quoted(filled(F.col("cwd")))), item("Started", filled(F.col("started_at"))), item("Duration", hours_minutes(F.col("duration_secs"))),
        item(VERSION, filled(F.col("claude_version"))), item("Slug", quoted(filled(F.col("slug")))), item("Session UUID", quoted(F.col("session_uuid"))), item("Tools used", tools), files, F.lit("\n## Conversation\n"),
    )
    said = F.array_join(F.transform(F.coalesce("t", F.array().cast("array<struct<timestamp:string,seq:int,md:string>>")), lambda x: x["md"]), "\n")
    return sessions.join(talk, "session_uuid", "left").select("session_uuid", export_name(F.col("slug"), F.col("session_uuid"), F.col("started_at")).alias("filename"), F.concat_ws("\n", meta, said).alias("markdown"))


def write_markdown(documents: DataFrame, path: str) -> DataFrame:
    """Writes each row's markdown as a file of its filename below path, and returns filename and bytes.

    Characters that file names can't hold become dashes; documents whose names then agree, as sessions of one slug and day, are told
    apart by the session's id. A file is written under a name of its attempt and then moved, so a repeated task leaves whole files.
    """
    named = documents.select(F.regexp_replace("filename", r'[\\/:*?"<>|\x00-\x1f]', "-").alias("filename"), "session_uuid", "markdown")
    twice = named.groupBy("filename").agg(F.count("*").alias("n"))
    named = named.join(twice, "filename").select(F.when(F.col("n") == 1, F.col("filename")).otherwise(F.concat(F.regexp_replace("filename", r"[.]md$", "-"), F.regexp_replace("session_uuid", r"[^0-9A-Za-z_-]", "-"), F.lit(".md"))).alias("filename"), "markdown")

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            sizes = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                with store.open_output_stream(f"{root}/_{name}.{attempt}") as out:
                    out.write(data)
                store.move(f"{root}/_{name}.{attempt}", f"{root}/{name}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["filename", "bytes"])

    written = named.mapInArrow(write, "filename string, bytes long")
    written.write.mode("overwrite").parquet(f"{path}/_written")
    return documents.sparkSession.read.parquet(f"{path}/_written")


def as_json(rows: DataFrame) -> DataFrame:
    """One column, json: each row as a JSON object, nulls kept."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("json"))
