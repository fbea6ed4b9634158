"""From lines to messages, blocks and sessions: ordered folds as one aggregation for each session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import duration, filled, json_error, moment, project_name, summary

KINDS = ("queue-operation", "user", "assistant", "file-history-snapshot", "ai-title", "last-prompt")
WRITERS = ("Write", "Edit")
RECORD = (
    "type string, isMeta boolean, operation string, sessionId string, uuid string, parentUuid string, timestamp string, cwd string, gitBranch string, entrypoint string, version string, slug string, permissionMode string,"
    " aiTitle string, lastPrompt string, snapshot struct<trackedFileBackups: string>, message struct<content: string, usage: struct<input_tokens: string, output_tokens: string, cache_read_input_tokens: string, cache_creation_input_tokens: string>>"
)
BLOCK = "type string, text string, name string, id string, input string, tool_use_id string, content string, source struct<media_type: string>"


def _image(media_type: Column) -> Column:
    return F.to_json(F.struct(F.lit("image").alias("type"), F.lit(True).alias("omitted"), F.coalesce(media_type, F.lit("image/unknown")).alias("media_type")))


def with_field(text: Column, key: str, value: Column) -> Column:
    """A JSON object's text with key's value replaced by a JSON text. Fields may change places."""
    fields = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    return F.to_json(F.transform_values(fields, lambda k, v: F.when(k == key, F.try_parse_json(value)).otherwise(v)))


def _nests_image(block: Column) -> Column:
    return F.coalesce((F.get_json_object(block, "$.type") == "tool_result") & F.get_json_object(block, "$.content").contains('"image"'), F.lit(False))


def _without_nested(block: Column) -> Column:
    """A tool result's JSON with each image in its content replaced by what was left out."""
    parts = F.try_variant_get(F.try_parse_json(block), "$.content", "array<variant>")
    kept = F.transform(parts, lambda p: F.when(F.try_variant_get(p, "$.type", "string") == "image", F.try_parse_json(_image(F.try_variant_get(p, "$.source.media_type", "string")))).otherwise(p))
    return F.coalesce(F.when(parts.isNotNull(), with_field(block, "content", F.to_json(kept))), block)


def records(lines: DataFrame, strict: bool = True, nested_images: bool = False, string_content: str = "drop") -> DataFrame:
    """Lines with the record r, an error text for lines that can't be used, and content as block texts.

    A line that isn't JSON, isn't an object, or has an unknown type gets an error and is left out of all
    else. Content that isn't a list counts as no blocks, even if its text looks like one; with string_content="text", a plain
    string counts as one block of text. Items that
    aren't objects stay as JSON and have no type. With strict, trailing garbage after a JSON value is an error
    too (checked in Python); without, all stays in the JVM. Images inside tool results are replaced like
    others, unless nested_images keeps them.
    """
    # parsed once: the value tells whether a line is JSON, and what its content is
    lines = lines.withColumn("value", F.expr("try_parse_json(line)"))
    bad = json_error("line") if strict else F.when(F.trim("line") != "", F.when(F.col("value").isNull(), F.lit("not JSON")))
    known = lines.withColumn("bad", bad).withColumn("r", F.from_json(F.when(F.col("bad").isNull(), F.col("line")), RECORD))
    blank = F.trim(F.coalesce("line", F.lit(""))) == ""
    object_ = F.ltrim("line").startswith("{")
    why = F.when(blank, None).when(F.col("bad").isNotNull(), F.col("bad")).when(~object_, "not an object").when(~F.coalesce(F.col("r.type").isin(*KINDS), F.lit(False)), F.concat(F.lit("unknown type '"), F.coalesce(F.col("r.type"), F.lit("None")), F.lit("'")))
    content = F.col("r.message.content")
    shape = F.expr("coalesce(schema_of_variant(try_variant_get(value, '$.message.content', 'variant')), '')")
    items = F.from_json(content, "array<string>")
    others = F.transform(F.expr("try_variant_get(value, '$.message.content', 'array<variant>')"), lambda v: F.when(~F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v)))
    raw = F.when(F.ltrim(content).startswith("[") & shape.startswith("ARRAY"), F.when(shape.startswith("ARRAY<OBJECT"), items).otherwise(F.zip_with(items, others, lambda i, o: F.coalesce(o, i))))
    if string_content == "text":
        raw = F.when(shape == "STRING", F.array(F.to_json(F.struct(F.lit("text").alias("type"), content.alias("text"))))).otherwise(raw)
    elif string_content != "drop":
        raise ValueError(f"string_content is drop or text, not {string_content}")
    nests = F.lit(False) if nested_images else F.col("line").contains('"tool_result"') & F.col("line").contains('"image"') & F.exists("raw_blocks", _nests_image)
    out = known.withColumn("error", F.when(why.isNotNull(), F.format_string("line %d: %s", "line_no", why)))
    ok = F.col("error").isNull() & ~blank
    out = out.withColumn("kind", F.when(ok, F.col("r.type"))).withColumn("meta", F.coalesce(F.col("r.isMeta"), F.lit(False)) & (F.col("kind") == "user"))
    turn = F.col("kind").isin("user", "assistant") & ~F.col("meta")
    out = out.withColumn("turn", F.coalesce(turn, F.lit(False))).withColumn("raw_blocks", F.when(turn, F.coalesce(raw, F.array().cast("array<string>"))))
    out = out.withColumn("nests", F.coalesce(nests, F.lit(False)))
    out = out.withColumn("raw_blocks", F.when(F.col("nests"), F.transform("raw_blocks", lambda b: F.when(_nests_image(b), _without_nested(b)).otherwise(b))).otherwise(F.col("raw_blocks")))
    return out.withColumn("parts", F.transform("raw_blocks", lambda b: F.from_json(b, BLOCK))).drop("bad", "value")


def cleaned(raw: Column, part: Column) -> Column:
    """A block's JSON: images and thinking are replaced by what was left out."""
    return F.when(part["type"] == "image", _image(part["source"]["media_type"])).when(part["type"] == "thinking", '{"type":"thinking","omitted":true}').otherwise(raw)


def _names(parts: Column) -> Column:
    return F.transform(F.filter(parts, lambda b: b["type"] == "tool_use"), lambda b: F.coalesce(b["name"], F.lit("")))


def _texts(parts: Column) -> Column:
    return F.transform(F.filter(parts, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))


def _has(parts: Column, kind: str) -> Column:
    return F.exists(parts, lambda b: F.coalesce(b["type"] == kind, F.lit(False)))


def messages(recs: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row for each turn, keyed by "{session}:{uuid}"; of equal keys the first line stays."""
    role = F.col("kind")
    uuid = F.when(F.array_contains(F.json_object_keys("line"), "uuid"), F.coalesce("r.uuid", F.lit(""))).otherwise(F.format_string("_line_%d", "line_no"))
    content = F.concat(F.lit("["), F.array_join(F.zip_with("raw_blocks", "parts", cleaned), ","), F.lit("]"))
    assistant = role == "assistant"
    rows = recs.where("turn").join(sessions.select("path", "session_uuid"), "path").select(
        F.concat_ws(":", "session_uuid", uuid).alias("id"), "session_uuid", F.col("line_no").alias("seq"), uuid.alias("uuid"), F.col("r.parentUuid").alias("parent_uuid"), role.alias("type"), role.alias("role"),
        F.col("r.timestamp").alias("timestamp"), moment(F.col("r.timestamp")).alias("ts"), (assistant & _has(F.col("parts"), "tool_use")).alias("has_tool_use"), (assistant & _has(F.col("parts"), "thinking")).alias("has_thinking"),
        _has(F.col("parts"), "image").alias("has_image"), F.when(assistant, _names(F.col("parts"))).otherwise(F.array().cast("array<string>")).alias("tool_names"), content.alias("content_json"),
    )
    return rows.groupBy("id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "id"]), "seq").alias("m")).select("id", "m.*")


def blocks(recs: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row for each content block, in order."""
    rows = recs.where("turn").join(sessions.select("path", "session_uuid"), "path").select("session_uuid", F.col("line_no").alias("seq"), F.posexplode(F.arrays_zip("parts", "raw_blocks")).alias("block_idx", "z")).withColumns({"b": F.col("z.parts"), "raw": F.col("z.raw_blocks")})
    # a text may look like a list: the kind comes from the block itself, and only tool results are looked at
    listed = F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.when(F.col("b.type") == "tool_result", F.col("raw"))), "$.content", "variant")).startswith("ARRAY")
    path = F.coalesce(filled(F.get_json_object("b.input", "$.file_path")), filled(F.get_json_object("b.input", "$.path")))
    return rows.select("session_uuid", "seq", "block_idx", F.col("b.type").alias("block_type"), F.col("b.text").alias("text"), F.col("b.name").alias("tool_name"), F.col("b.input").alias("tool_input"), path.alias("file_path"), F.coalesce("b.tool_use_id", "b.id").alias("tool_use_id"), F.col("b.content").alias("result"), F.coalesce(listed, F.lit(False)).alias("result_listed"), F.col("b.source.media_type").alias("media_type"))


def sessions(recs: DataFrame, ingest_at: str, writers: tuple[str, ...] = WRITERS) -> DataFrame:
    """The fold of a file's lines into one row: first and last values by line number, sums, sets and texts.

    ingest_at is the ISO time that stands in for a missing start. Files without a session id have a null
    session_uuid, which the caller sets aside.
    """
    kind, no = F.col("kind"), F.col("line_no")
    turn, user, assistant = F.col("turn"), F.col("turn") & (kind == "user"), kind == "assistant"

    def first(field: str, when: Column) -> Column:
        return F.min_by(F.col(f"r.{field}"), F.when(when & (F.col(f"r.{field}") != ""), no))

    has_id = kind.isin("queue-operation", "assistant", "ai-title", "last-prompt") | user
    starts = turn | ((kind == "queue-operation") & (F.col("r.operation") == "enqueue"))
    usage = lambda f: F.sum(F.when(assistant, F.coalesce(F.expr(f"try_cast(r.message.usage.{f} AS bigint)"), F.lit(0).cast("long"))).otherwise(0)).alias
    parts = F.coalesce("parts", F.from_json(F.lit("[]"), f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in BLOCK.split(', '))}>>"))
    calls = F.filter(parts, lambda b: assistant & (b["type"] == "tool_use"))
    written = F.transform(F.filter(calls, lambda b: b["name"].isin(*writers)), lambda b: F.coalesce(filled(F.get_json_object(b["input"], "$.file_path")), filled(F.get_json_object(b["input"], "$.path")), F.lit("")))
    kept = F.coalesce(F.json_object_keys("r.snapshot.trackedFileBackups"), F.array().cast("array<string>"))
    text = lambda role: F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(turn & (kind == role), F.struct("line_no", _texts(F.col("parts")).alias("t"))))), lambda x: x["t"])), "\n\n")
    filled_texts = F.filter(F.transform(_texts(F.col("parts")), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")
    prompt = F.try_element_at(filled_texts, F.lit(1))
    folded = recs.groupBy("path").agg(
        F.first("source_id").alias("source_id"), F.first("project_dir").alias("project_dir"), F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("line_no", "error")))).alias("errors"),
        first("sessionId", has_id).alias("session_uuid"), *[first(f, user).alias(n) for f, n in (("cwd", "cwd"), ("gitBranch", "git_branch"), ("entrypoint", "entrypoint"), ("version", "claude_version"), ("slug", "slug"), ("permissionMode", "permission_mode"))],
        F.max_by(F.struct(F.col("r.aiTitle").alias("v")), F.when(kind == "ai-title", no))["v"].alias("ai_title"), F.max_by(F.struct(F.col("r.lastPrompt").alias("v")), F.when(kind == "last-prompt", no))["v"].alias("last_prompt"),
        first("timestamp", starts).alias("first_at"), F.max_by(F.col("r.timestamp"), F.when(turn & (F.col("r.timestamp") != ""), no)).alias("ended_at"),
        F.count_if(turn).alias("message_count"), F.count_if(user).alias("user_message_count"), F.count_if(assistant).alias("asst_message_count"), F.sum(F.size(calls)).cast("long").alias("tool_use_count"),
        F.coalesce(F.bool_or(F.exists(calls, lambda b: b["name"] == "Agent")), F.lit(False)).alias("has_subagents"),
        usage("input_tokens")("input_tokens"), usage("output_tokens")("output_tokens"), usage("cache_read_input_tokens")("cache_read_tokens"), usage("cache_creation_input_tokens")("cache_write_tokens"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_distinct(F.transform(calls, lambda b: F.coalesce(b["name"], F.lit(""))))))) ).alias("tools_used"),
        F.slice(F.array_sort(F.filter(F.array_distinct(F.flatten(F.collect_list(F.array_union(written, kept)))), lambda f: f != "")), 1, 50).alias("files_modified"),
        text("user").alias("user_messages"), text("assistant").alias("asst_messages"),
        F.min_by(F.struct(prompt.alias("v")), F.when(user & (F.size("raw_blocks") > 0), no))["v"].alias("prompt"),
    )
    out = folded.withColumn("project_name", project_name(F.col("project_dir"), F.col("cwd"))).withColumn("started_at", F.coalesce("first_at", F.lit(ingest_at))).withColumn("duration_secs", duration(F.col("first_at"), F.col("ended_at")))
    return out.withColumns({
        "parse_errors": F.transform("errors", lambda e: e["error"]), "id": F.sha2(F.concat("session_uuid", F.coalesce("first_at", F.lit(""))), 256), "started_ts": moment(F.col("started_at")), "ended_ts": moment(F.col("ended_at")),
        "backed_up_at": F.lit(ingest_at), "summary": summary(F.col("ai_title"), F.col("prompt"), F.col("files_modified"), F.col("tools_used")), "schema_version": F.lit(1), "source_path": F.col("path"),
    }).drop("errors", "first_at", "prompt")


def raw_transcripts(recs: DataFrame, sessions_: DataFrame) -> DataFrame:
    """session_uuid and its whole transcript with cleaned content, line by line.

    Lines with nothing to clean are as they were; in others all fields stay, but may change places.
    """
    content = F.concat(F.lit("["), F.array_join(F.zip_with("raw_blocks", "parts", cleaned), ","), F.lit("]"))
    again = with_field(F.col("line"), "message", with_field(F.get_json_object("line", "$.message"), "content", content))
    changed = F.col("turn") & (F.col("nests") | F.exists("parts", lambda b: F.coalesce(b["type"].isin("image", "thinking"), F.lit(False))))
    line = F.when(changed, again).otherwise(F.trim("line"))
    rows = recs.where(F.trim("line") != "").join(sessions_.select("path", "session_uuid"), "path").groupBy("session_uuid").agg(F.array_sort(F.collect_list(F.struct("line_no", line.alias("l")))).alias("x"))
    return rows.select("session_uuid", F.array_join(F.transform("x", lambda v: v["l"]), "\n").alias("raw_jsonl"))
