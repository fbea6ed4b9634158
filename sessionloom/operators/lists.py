"""Filters, pages and counts over sessions."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def since_text(since: str | None, now: datetime) -> str | None:
    """Nd: N days before now; blank: none; else as it is."""
    if not since or not since.strip():
        return None
    days = re.fullmatch(r"(\d+)d", since.strip())
    return (now - timedelta(days=int(days[1]))).strftime("%Y-%m-%dT%H:%M:%SZ") if days else since.strip()


def since_days(since: str | None, default: int = 365) -> int:
    """Nd: N; anything else: default."""
    days = re.fullmatch(r"(\d+)d", (since or "").strip())
    return int(days[1]) if days else default


def matching(sessions: DataFrame, now: datetime, project: str | None = None, branch: str | None = None, since: str | None = None, until: str | None = None, tool: str | None = None, compare: str = "time", tool_match: str = "exact") -> DataFrame:
    """Sessions that pass all given filters; a blank one doesn't filter.

    Times compare as instants and a date as until takes in its whole day; compare="text" compares the
    stored text. A tool matches by its whole name; tool_match="substring" by any part, without case.
    """
    df = sessions
    if project:
        df = df.where(F.col("project_name") == project)
    if branch:
        df = df.where(F.col("git_branch") == branch)
    start = since_text(since, now)
    if compare == "text":
        df = df.where(F.col("started_at") >= start) if start else df
        df = df.where(F.col("started_at") <= until) if until else df
    else:
        df = df.where(F.col("started_ts") >= F.try_to_timestamp(F.lit(start))) if start else df
        if until:
            end = F.try_to_timestamp(F.lit(until))
            day = re.fullmatch(r"\d{4}-\d\d-\d\d", until)
            df = df.where(F.col("started_ts") < end + F.expr("interval 1 day")) if day else df.where(F.col("started_ts") <= end)
    if tool:
        df = df.where(F.array_contains("tools_used", tool) if tool_match == "exact" else F.lower(F.array_join("tools_used", '", "')).contains(tool.lower()))
    return df


def page(sessions: DataFrame, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """Sessions by start, the latest first; ties by id."""
    return matching(sessions, **filters).orderBy(F.desc("started_at"), "session_uuid").offset(max(0, offset)).limit(min(500, max(1, limit)))


def page_after(sessions: DataFrame, started_at: str, session_uuid: str, limit: int = 50, **filters) -> DataFrame:
    """The page that follows a row, without counting rows before it."""
    after = (F.col("started_at") < started_at) | ((F.col("started_at") == started_at) & (F.col("session_uuid") > session_uuid))
    return page(sessions.where(after), limit, 0, **filters)


def count(sessions: DataFrame, **filters) -> DataFrame:
    return matching(sessions, **filters).agg(F.count("*").alias("total"))


def envelope(sessions: DataFrame, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """One row: the page as items, total, and has_more."""
    rows = page(sessions, limit, offset, **filters).agg(F.array_sort(F.collect_list(F.struct("started_at", "session_uuid"))).alias("items"))
    return rows.crossJoin(F.broadcast(count(sessions, **filters))).withColumn("has_more", F.lit(offset) + F.size("items") < F.col("total"))


def message_list(messages: DataFrame) -> DataFrame:
    """Messages of each session in time order, those without time first; ties by line."""
    return messages.orderBy("session_uuid", "timestamp", "seq")


def with_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with their messages nested in order."""
    nested = messages.groupBy("session_uuid").agg(F.array_sort(F.collect_list(F.struct("timestamp", "seq", "id", "role", "content_json"))).alias("messages"))
    return sessions.join(nested, "session_uuid", "left")
