"""Rollups of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0).cast("long"))


def totals(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count("*").alias("session_count"), _total("duration_secs").alias("total_duration_secs"), _total("input_tokens").alias("total_input_tokens"), _total("output_tokens").alias("total_output_tokens"))


def recent(sessions: DataFrame, now: str, days: int = 7) -> DataFrame:
    return sessions.agg(F.count_if(F.col("started_ts") >= F.to_timestamp(F.lit(now)) - F.expr(f"interval {days} days")).alias("sessions_this_week"))


def projects(sessions: DataFrame) -> DataFrame:
    """A row for each project; folder and cwd come from the session stored last (ties by id)."""
    return project_parts(sessions).drop("last")


ROLLUP = ("session_count", "total_duration_secs", "total_input_tokens", "total_output_tokens")


def project_parts(sessions: DataFrame) -> DataFrame:
    """The rollup of projects with `last`, the time and id of the session stored last, so that rollups can be put together."""
    key = F.struct("backed_up_at", "session_uuid")
    rows = sessions.groupBy("project_name").agg(F.max_by(F.struct("project_dir", "cwd"), key).alias("l"), F.max(key).alias("last"), F.count("*").alias("session_count"), F.max("started_at").alias("last_active"), _total("duration_secs").alias("total_duration_secs"), _total("input_tokens").alias("total_input_tokens"), _total("output_tokens").alias("total_output_tokens"))
    return rows.select("project_name", "l.project_dir", "l.cwd", "session_count", "last_active", "total_duration_secs", "total_input_tokens", "total_output_tokens", "last")


def changed_projects(stored: DataFrame, added: DataFrame, taken: DataFrame) -> DataFrame:
    """The parts of projects after sessions came and went, with `lost`: whether its latest session or time went and nothing as
    late came, so that the row must be made from the sessions. Projects left without sessions have a session_count of 0."""
    def marked(parts: DataFrame, sign: int, new: int) -> DataFrame:
        return parts.select("project_name", "project_dir", "cwd", "last_active", "last", *[(F.col(c) * sign).alias(c) for c in ROLLUP], F.lit(new).alias("new"))

    rows = marked(stored, 1, 0).unionByName(marked(added, 1, 1)).unionByName(marked(taken, -1, -1))
    here, went, came = F.col("new") >= 0, F.col("new") < 0, F.col("new") > 0
    latest = lambda c, when: F.max(F.when(when, F.col(c)))
    merged = rows.groupBy("project_name").agg(
        F.max_by(F.struct("project_dir", "cwd"), F.when(here, F.struct("last", "new"))).alias("l"), latest("last_active", here).alias("last_active"), latest("last", here).alias("last"), *[F.sum(c).alias(c) for c in ROLLUP],
        *[latest(c, when).alias(f"{c}_{name}") for c in ("last", "last_active") for when, name in ((went, "went"), (came, "came"))],
    )

    def lost(c: str) -> Column:
        return F.coalesce((F.col(f"{c}_went") >= F.col(c)) & F.coalesce(F.col(f"{c}_came") < F.col(c), F.lit(True)), F.lit(False))

    return merged.select("project_name", "l.project_dir", "l.cwd", "session_count", "last_active", "total_duration_secs", "total_input_tokens", "total_output_tokens", "last", ((F.col("session_count") > 0) & (lost("last") | lost("last_active"))).alias("lost"))


def top_projects(sessions: DataFrame, limit: int | None = 10) -> DataFrame:
    rows = sessions.groupBy("project_name").agg(F.count("*").alias("session_count"), F.max("started_at").alias("last_active")).orderBy(F.desc("session_count"), "project_name")
    return rows.limit(limit) if limit else rows


def top_tools(sessions: DataFrame, limit: int = 10) -> DataFrame:
    """Tools by the number of sessions that use them."""
    return sessions.select(F.explode("tools_used").alias("tool")).groupBy("tool").agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "tool").limit(limit)


def timeline(sessions: DataFrame, now: str, days: int = 365) -> DataFrame:
    rows = sessions.where(F.col("started_ts") >= F.to_timestamp(F.lit(now)) - F.expr(f"interval {days} days"))
    return rows.groupBy(F.substring("started_at", 1, 10).alias("day")).agg(F.count("*").alias("sessions")).orderBy("day")


def heatmap(sessions: DataFrame, today: str, days: int = 182) -> DataFrame:
    """Each of the last days with its count and level (at most 4), zeros included."""
    spark = sessions.sparkSession
    all_days = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(today).cast("date"), days - 1), F.lit(today).cast("date"))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    counts = sessions.groupBy(F.substring("started_at", 1, 10).alias("day")).agg(F.count("*").alias("n"))
    return all_days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("sessions"), F.least(F.coalesce("n", F.lit(0)), F.lit(4)).cast("int").alias("level"))


def branches(sessions: DataFrame, window: int | None = 200, limit: int = 12) -> DataFrame:
    """Branches of the latest sessions (all, if window is None), most used first; blanks left out."""
    rows = sessions.select("started_at", "session_uuid", "git_branch")
    rows = rows.orderBy(F.desc("started_at"), "session_uuid").limit(window) if window else rows
    return rows.where(F.trim("git_branch") != "").groupBy("git_branch").agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "git_branch").limit(limit)


def storage(files: DataFrame) -> DataFrame:
    return files.agg(_total("file_size_bytes").alias("bytes"))
