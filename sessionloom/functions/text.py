"""Column functions for session facts."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _json_error(lines: pd.Series) -> pd.Series:
    def check(line: str | None) -> str | None:
        if line is None or not line.strip():
            return None
        try:
            json.loads(line)
        except ValueError as e:
            return str(e)
        return None

    return lines.map(check).astype(object)


#: A key that no line can hold by chance.
MARK = uuid.uuid4().hex


def json_error(line: Column) -> Column:
    """Why a line isn't one JSON value; null if it is, or if it is blank.

    A line stands as a value before a key of this run's own: only if it is one whole value, the object has just these two
    keys. Only lines that this doesn't settle go to Python, for its verdict and its words.
    """
    whole = F.try_parse_json(F.concat(F.lit('{"line":'), line, F.lit(f',"{MARK}":0}}')))
    keys = F.map_keys(F.try_variant_get(whole, "$", "map<string,variant>"))
    sound = F.coalesce(F.size(keys) == 2, F.lit(False)) & F.coalesce(F.array_contains(keys, MARK), F.lit(False))
    return _json_error(F.when(~sound, line))


@F.pandas_udf(StringType())
def indented(values: pd.Series) -> pd.Series:
    """JSON text with an indent of two; other text as it is."""

    def show(value: str | None) -> str:
        try:
            return json.dumps(json.loads(value or "{}") or {}, indent=2)
        except ValueError:
            return value

    return values.map(show)


def filled(c: Column) -> Column:
    """Null for an empty string."""
    return F.when(c != "", c)


def project_name(project_dir: Column, cwd: Column) -> Column:
    """The last part of cwd (unknown for the root), else the last dash part of the folder's name."""
    last = F.element_at(F.split(F.regexp_replace(cwd, "/+$", ""), "/"), -1)
    return F.when(filled(cwd).isNotNull(), F.coalesce(filled(last), F.lit("unknown"))).otherwise(F.substring_index(project_dir, "-", -1))


def moment(text: Column) -> Column:
    return F.try_to_timestamp(text)


def duration(start: Column, end: Column) -> Column:
    """Whole seconds, at least 0; null if an end is missing, unreadable, or only one of them names a zone."""
    zoned = lambda t: t.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    seconds = F.floor((F.unix_micros(moment(end)) - F.unix_micros(moment(start))) / 1_000_000)
    return F.when(zoned(start) == zoned(end), F.greatest(F.lit(0).cast("long"), seconds.cast("long")))


def summary(title: Column, prompt: Column, files: Column, tools: Column) -> Column:
    """Title, first prompt, files and tools in at most 280 characters."""
    cut = F.when(F.length(prompt) > 120, F.concat(F.substring(prompt, 1, 120), F.lit("..."))).otherwise(prompt)
    names = F.transform(F.slice(files, 1, 3), lambda f: F.element_at(F.split(f, "/"), -1))
    listed = F.when(F.size(files) > 0, F.concat(F.lit("Files: "), F.array_join(names, ", "), F.when(F.size(files) > 3, "...").otherwise("")))
    used = F.when(F.size(tools) > 0, F.concat(F.lit("Tools: "), F.array_join(F.slice(tools, 1, 5), ", ")))
    text = F.concat_ws(". ", F.coalesce(filled(title), F.lit("Untitled session")), filled(cut), listed, used)
    return F.when(F.length(text) > 280, F.concat(F.substring(text, 1, 277), F.lit("..."))).otherwise(text)


def tool_result_text(content: Column, listed: Column) -> Column:
    """Null: empty; text: itself, also if it looks like a list; list: the texts of its objects and its strings as they are, one a
    line, without empty ones and without items of other kinds; else its JSON.

    listed tells whether the content was a list."""
    parts = F.try_variant_get(F.try_parse_json(F.when(listed, content)), "$", "array<variant>")

    def text(item: Column) -> Column:
        kind = F.schema_of_variant(item)
        return F.when(kind.startswith("OBJECT"), F.try_variant_get(item, "$.text", "string")).when(kind == "STRING", F.try_variant_get(item, "$", "string"))

    return F.when(content.isNull(), "").when(listed & parts.isNotNull(), F.array_join(F.filter(F.transform(parts, text), lambda t: t != ""), "\n")).otherwise(content)


def hours_minutes(seconds: Column) -> Column:
    return F.when(seconds > 0, F.format_string("%dh %dm", F.floor(seconds / 3600).cast("long"), F.floor((seconds % 3600) / 60).cast("long")))


def export_name(slug: Column, uuid: Column, started: Column) -> Column:
    return F.replace(F.concat(F.coalesce(filled(slug), F.substring(uuid, 1, 8)), F.lit("-"), F.substring(started, 1, 10), F.lit(".md")), F.lit("--"), F.lit("-"))


def display_paths(files: Column, cwd: Column) -> Column:
    """Paths as seen from cwd; those outside it stay."""
    below = F.concat(cwd, F.lit("/"))
    return F.transform(files, lambda f: F.when(f.startswith(below), F.substr(f, F.length(below) + 1)).otherwise(f))


def tool_line(tool_input: Column) -> Column:
    """The first telling field of a tool's input, in at most 120 characters."""
    fields = [filled(F.get_json_object(tool_input, f"$.{k}")) for k in ("description", "command", "file_path", "query", "path")]
    return F.substring(F.coalesce(*fields, F.lit("tool input")), 1, 120)
