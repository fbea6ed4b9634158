"""Transcripts without private content: texts, paths and inputs go, shapes and counts stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Wording of the stand-ins.
TEXT = "(text left out)"
TEXT_WITH = "(text left out, it names: %s)"
TITLE, TITLE_WITH = "A session", "A session about %s"
PROMPT, THINKING = "(prompt left out)", "(thoughts left out)"
PATH = "files/file-%02d.txt"

COMMON = ("type", "uuid", "parentUuid", "sessionId", "timestamp")
USER = ("isMeta", "entrypoint", "version", "slug", "permissionMode", "gitBranch", "cwd")
USAGE = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")


def _kept(text: Column, keywords: tuple[str, ...], joint: str) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(text.contains(k), k) for k in sorted(set(keywords))] or [F.lit(None).cast("string")])), joint)


def scrub_text(text: Column, keywords: tuple[str, ...] = ()) -> Column:
    """A stand-in for the text that names the keywords in it, sorted. Null and empty stay."""
    kept = _kept(text, keywords, ", ")
    return F.when(text == "", text).when(text.isNotNull(), F.when(kept != "", F.format_string(TEXT_WITH, kept)).otherwise(TEXT))


def path_names(uses: DataFrame, key: str = "session_uuid", order: tuple[str, ...] = ("seq", "block_idx"), path_col: str = "file_path") -> DataFrame:
    """key, path_col, safe_path: the distinct paths of each key, numbered as they are first seen.

    uses has a row for each use of a path; null and empty paths are left out. Uses at one place are told apart
    by the path. The uses are reduced to distinct paths before they are ordered.
    """
    first = uses.where(F.col(path_col) != "").groupBy(key, path_col).agg(F.min(F.struct(*order)).alias("_first"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("_first", path_col))
    return first.select(key, path_col, F.format_string(PATH, number).alias("safe_path"))


def pseudonymize_paths(uses: DataFrame, key: str = "session_uuid", order: tuple[str, ...] = ("seq", "block_idx"), path_col: str = "file_path") -> DataFrame:
    """uses with safe_path beside each path; one path has one stand-in within a key."""
    names = path_names(uses, key, order, path_col)
    return uses.join(names, [key, path_col], "left")


def anonymised(recs: DataFrame, keywords: tuple[str, ...] = (), home: str = "", safe_home: str = "") -> DataFrame:
    """path, line_no, line: each usable record as JSON with only the fields that parsing reads.

    Texts become stand-ins, tool inputs keep just their file path, under a name numbered by file, and images lose
    their data. A cwd below home moves below safe_home. Plain string content becomes one text block.
    Lines with an error are left out; a turn that isn't one (meta) keeps no message.
    """
    used = recs.where("kind IS NOT NULL")
    tool_path = lambda b: F.coalesce(F.get_json_object(b["input"], "$.file_path"), F.get_json_object(b["input"], "$.path"))
    snapshot = F.when(F.col("kind") == "file-history-snapshot", F.filter(F.json_object_keys("r.snapshot.trackedFileBackups"), lambda p: p != ""))
    paths = F.coalesce(snapshot, F.transform(F.filter("parts", lambda b: b["type"] == "tool_use"), tool_path))
    uses = used.select("path", F.col("line_no").alias("seq"), F.posexplode(paths).alias("block_idx", "file_path"))
    names = path_names(uses, "path").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("file_path", "safe_path"))).alias("names"))

    def block(b: Column) -> Column:
        kind = b["type"]
        safe = F.struct(F.element_at("names", tool_path(b)).alias("file_path"))
        source = F.struct(F.lit("base64").alias("type"), F.lit("image/png").alias("media_type"), F.lit("").alias("data"))
        return F.struct(
            kind.alias("type"), F.when(kind == "text", F.coalesce(scrub_text(b["text"], keywords), F.lit(""))).alias("text"), F.when(kind == "tool_use", b["name"]).alias("name"), F.when(kind == "tool_use", b["id"]).alias("id"), F.when(kind == "tool_use", safe).alias("input"),
            F.when(kind == "tool_result", b["tool_use_id"]).alias("tool_use_id"), F.when(kind == "tool_result", scrub_text(b["content"], keywords)).alias("content"), F.when(kind == "image", source).alias("source"), F.when(kind == "thinking", THINKING).alias("thinking"),
        )

    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    plain = F.when(is_("user") & (F.col("r.message.content") != "") & ~F.col("r.message.content").startswith("["), F.col("r.message.content"))
    texts = F.array(F.struct(F.lit("text").alias("type"), plain.alias("text"), *[F.lit(None).cast("string").alias(f) for f in ("name", "id", "input", "tool_use_id", "content")]))
    said = F.when(F.size("parts") > 0, F.transform("parts", block)).when(plain.isNotNull(), F.transform(texts, block)).otherwise(F.array())
    usage = F.when(is_("assistant"), F.struct(*[F.expr(f"try_cast(r.message.usage.{u} AS bigint)").alias(u) for u in USAGE]))
    message = F.when(F.col("turn"), F.struct(F.col("kind").alias("role"), said.alias("content"), usage.alias("usage")))
    cwd = F.when(F.col("r.cwd").startswith(home), F.concat(F.lit(safe_home), F.substr(F.col("r.cwd"), F.lit(len(home) + 1)))).otherwise(F.col("r.cwd")) if home else F.col("r.cwd")
    user = [F.when(is_("user"), cwd if f == "cwd" else F.col(f"r.{f}")).alias(f) for f in USER]
    backups = F.map_from_entries(F.transform(F.coalesce(snapshot, F.array().cast("array<string>")), lambda p: F.struct(F.element_at(F.col("names"), p).alias("k"), F.struct(F.lit(1).alias("version")).alias("v"))))
    words = _kept(F.col("r.aiTitle"), keywords, " ")
    title = F.when(F.coalesce(words, F.lit("")) != "", F.format_string(TITLE_WITH, words)).otherwise(TITLE)
    line = F.to_json(F.struct(
        *[F.col(f"r.{f}").alias(f) for f in COMMON], F.when(is_("queue-operation"), F.col("r.operation")).alias("operation"), *user, message.alias("message"),
        F.when(is_("file-history-snapshot"), F.struct(backups.alias("trackedFileBackups"))).alias("snapshot"), F.when(is_("ai-title"), title).alias("aiTitle"), F.when(is_("last-prompt"), PROMPT).alias("lastPrompt"),
    ))
    return used.join(names, "path", "left").select("path", "line_no", line.alias("line"))
