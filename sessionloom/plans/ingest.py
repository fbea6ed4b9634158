"""Ingest: new session files to stored tables, with an outcome for every file."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lists, search, stats, topk
from ..operators.redact import COMPAT, RULES, STRICT, Rule, redact, redacted, redacted_lines
from ..operators.tables import Store, first_of_batch
from ..sources import sessions as files_of
from ..sources.sessions import ADAPTERS, Source, hashed, list_files, range_lines, read_files
from . import parsing

LOG = "path string, path_key string, session_uuid string, status string, reason string, file_hash string, file_size_bytes long, modified timestamp, ingest_at string"


def read_records(lines: DataFrame, rules: tuple[Rule, ...] = RULES, scope: str = "strict", string_content: str = "drop") -> DataFrame:
    """The records of lines. Scope strict takes the secrets out of the lines first, so that nothing made of them holds any."""
    return parsing.records(redacted_lines(lines, rules) if scope == "strict" else lines, string_content=string_content)


def derive(recs: DataFrame, folded: DataFrame, rules: tuple[Rule, ...] = RULES, scope: str = "strict") -> dict[str, DataFrame]:
    """All tables of the sessions in folded, from the records that read_records gives of their files.

    Scope strict has had every string of every line redacted already; what is left are the file's path, and texts put together
    from several blocks. Compat redacts the texts and the transcript only, and the transcript as it is written.
    """
    kept = folded.where("session_uuid IS NOT NULL")
    messages, blocks, raw = parsing.messages(recs, kept), parsing.blocks(recs, kept), parsing.raw_transcripts(recs, kept)
    if scope != "strict":
        raw = raw.withColumn("raw_jsonl", F.array_join(F.transform(F.split("raw_jsonl", "\n"), lambda line: redacted(line, rules)), "\n"))
    sessions = redact(kept, STRICT if scope == "strict" else COMPAT, rules)
    fields = search.fields_of(sessions)
    return {"sessions": sessions, "messages": messages, "blocks": blocks, "sessions_raw": raw, "postings": search.postings(fields), "doc_stats": search.doc_stats(fields)}


def project_changes(store: Store, state: dict, added: DataFrame | None, taken: DataFrame | None) -> DataFrame:
    """The rollups of the projects that sessions come to or go from; one that is left without sessions has a count of 0.

    Stored rollups are changed by what comes and goes, from the buckets of their own projects. The sessions of a project are read again
    only where its latest session or time goes without one as late coming.
    """
    some = added if added is not None else taken
    plus, minus = (stats.project_parts(x if x is not None else some.where("false")) for x in (added, taken))
    old = store.near("projects", plus.select("project_name").unionByName(minus.select("project_name")), state)
    if old is None:
        return plus
    if "last" not in old.columns:
        # a store from before rollups could be put together
        old = stats.project_parts(store.read("sessions", state=state)).join(old.select("project_name"), "project_name", "left_semi")
    rows = stats.changed_projects(old.select(plus.columns), plus, minus)
    if taken is None:
        return rows.drop("lost")
    lost = rows.where("lost").select(F.col("project_name").alias("_name"))
    if lost.isEmpty():
        return rows.drop("lost")
    have = store.read("sessions", state=state).join(taken.select("session_uuid"), "session_uuid", "left_anti")
    have = have if added is None else have.unionByName(added, allowMissingColumns=True)
    again = stats.project_parts(have.join(lost, F.col("project_name").eqNullSafe(F.col("_name")), "left_semi"))
    return rows.where("NOT lost").drop("lost").unionByName(again)


def with_changes(store: Store, tables: dict[str, DataFrame], work: str, replace: bool = False) -> dict[str, DataFrame]:
    """The tables of a batch, and what the store keeps in step with them by changes: the dictionary of tokens, the sessions of
    each term, and the rollups of projects. Tokens that the dictionary knows don't go through Python again.

    What is needed more than once is written below work, which the caller deletes after publishing."""
    spark, state, sessions = store.spark, store.current(), tables["sessions"]

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{work}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{work}/{name}")

    fields, known = search.fields_of(sessions), store.read("terms", state=state)
    new = kept(search.new_terms(fields, known), "terms")
    dictionary = new if known is None else known.unionByName(new)
    postings = kept(search.postings(fields, dictionary=dictionary), "postings")
    gone = store.near("sessions", sessions, state) if replace else None
    impacts = kept(topk.impacts(postings, tables["doc_stats"]), "impacts")
    counts, cells = search.term_counts(postings, tables["doc_stats"]), topk.term_cells(impacts)
    if gone is not None:
        taken = taken_counts(gone, dictionary)
        counts, cells = counts.unionByName(taken["term_counts"]), cells.unionByName(taken["term_cells"])
    rows = kept(project_changes(store, state, sessions, gone), "projects")
    return tables | {"postings": postings, "impacts": impacts, "terms": new, "term_counts": counts, "term_cells": cells, "projects": rows}


def taken_counts(gone: DataFrame, dictionary: DataFrame) -> dict[str, DataFrame]:
    """What the counts lose with sessions."""
    fields = search.fields_of(gone)
    index, lengths = search.postings(fields, dictionary=dictionary), search.doc_stats(fields)
    return {"term_counts": search.term_counts(index, lengths, -1), "term_cells": topk.term_cells(topk.impacts(index, lengths), -1)}


def path_key(path: F.Column) -> F.Column:
    """What the log knows a file by: its path may hold a secret."""
    return F.sha2(path, 256)


def _unchanged(files: DataFrame, log: DataFrame) -> DataFrame:
    """The files that were looked at before at this length and modification time."""
    seen = log.where("status <> 'waiting'").select("path_key", F.col("file_size_bytes").alias("length"), "modified").distinct()
    return files.join(seen, ["path_key", "length", "modified"], "left_semi")


def ingest_available(spark: SparkSession, store: Store, sources: list[Source], ingest_at: str, rules: tuple[Rule, ...] = RULES, scope: str = "strict", on_change: str = "ignore", quiet_before: str | None = None, max_wait: int = 15, batch_id: str | None = None, string_content: str = "drop") -> DataFrame:
    """Takes in the files not stored yet and returns their outcomes: path, session_uuid, status, reason.

    Files taken in before at the same length and modification time are passed over without being opened, others with a stored
    hash before they are parsed; then sessions that are stored already (on_change="replace" puts the new file in
    their place), and later files of a session in the batch. Files changed after quiet_before wait for the next call, but
    not once max_wait seconds have gone by since the first time they waited. A file without session id is an error.
    string_content is that of parsing.records. Lines are parsed once and the records kept beside the tables until these are written.
    """
    counted(store)
    log, old = store.read("ingest_log"), store.read("sessions")
    log = log if log is not None else spark.createDataFrame([], LOG)
    listed = list_files(spark, sources).select("source_id", "source_ord", "path", path_key(F.col("path")).alias("path_key"), "modified", "length")
    passed = _unchanged(listed, log).select("path", F.lit("skipped").alias("status"), F.lit("file unchanged").alias("reason"), F.col("length").alias("file_size_bytes"), "modified")
    todo = listed.join(passed.select("path"), "path", "left_anti")
    if quiet_before:
        first = log.where("status = 'waiting'").groupBy("path_key").agg(F.min("ingest_at").alias("since"))
        waited = F.coalesce(F.unix_seconds(F.try_to_timestamp(F.lit(ingest_at))) - F.unix_seconds(F.try_to_timestamp("since")) >= max_wait, F.lit(False))
        todo = todo.join(first, "path_key", "left").withColumn("busy", F.col("modified") > F.to_timestamp(F.lit(quiet_before))).withColumn("late", F.col("busy") & waited)
        waiting = todo.where("busy AND NOT late").select("path", F.lit("waiting").alias("status"), F.lit("still changing").alias("reason"), F.col("length").alias("file_size_bytes"), "modified")
        passed, todo = passed.unionByName(waiting), todo.where("NOT busy OR late")
    if "late" not in todo.columns:
        todo = todo.withColumn("late", F.lit(False))
    by_hash = old.select("file_hash").distinct() if old is not None else spark.createDataFrame([], "file_hash string")
    work = f"{store.path}/_work/{uuid.uuid4().hex}"
    try:
        todo.write.parquet(f"{work}/todo")
        todo = spark.read.schema(todo.schema).parquet(f"{work}/todo")
        large = (F.col("length") > files_of.LARGE) & F.col("source_id").isin([s.id for s in sources if s.kind == "jsonl"])
        small = read_files(spark, sources, todo.where(~large))
        hashes = small.select("path", "file_hash").unionByName(hashed(todo.where(large)))
        facts = todo.join(hashes, "path").select("path", "source_id", "source_ord", "file_hash", F.col("length").alias("file_size_bytes"), "modified", "late")
        facts.write.parquet(f"{work}/facts")
        facts = spark.read.parquet(f"{work}/facts")
        fresh = facts.join(by_hash, "file_hash", "left_anti")
        wanted = todo.join(fresh.select("path"), "path", "left_semi")
        small, lines = read_files(spark, sources, wanted.where(~large)), range_lines(spark, wanted.where(large), f"{work}/lines")
        for s in sources:
            if s.enabled and s.kind in ADAPTERS:
                lines = lines.unionByName(ADAPTERS[s.kind](small.where(F.col("source_id") == s.id)))
        read_records(lines, rules, scope, string_content).write.parquet(f"{work}/records")
        recs = spark.read.parquet(f"{work}/records")
        parsing.sessions(recs, ingest_at).join(fresh.drop("source_id"), "path").write.parquet(f"{work}/sessions")
        folded = spark.read.parquet(f"{work}/sessions")
        known = old.select("session_uuid").distinct().withColumn("stored", F.lit(True)) if old is not None else spark.createDataFrame([], "session_uuid string, stored boolean")
        judged = folded.join(known, "session_uuid", "left")
        again = F.lit(on_change == "replace")
        offered = judged.where(F.col("session_uuid").isNotNull() & (F.col("stored").isNull() | again))
        chosen = first_of_batch(offered.drop("stored"))
        taken = chosen.select("path", F.lit(True).alias("taken"))
        status = F.when(F.col("session_uuid").isNull(), "error").when(F.col("taken"), "ok").otherwise("skipped")
        reason = F.when(status == "error", "no session id").when(status == "skipped", "session_uuid already indexed").when(F.col("late"), "taken while still changing")
        outcome = judged.join(taken, "path", "left").select("path", "session_uuid", status.alias("status"), reason.alias("reason"), "file_hash", "file_size_bytes", "modified")
        same = facts.join(by_hash, "file_hash", "left_semi").select("path", F.lit("skipped").alias("status"), F.lit("file_hash already indexed").alias("reason"), "file_hash", "file_size_bytes", "modified")
        rows = outcome.unionByName(same, allowMissingColumns=True).unionByName(passed, allowMissingColumns=True)
        rows = rows.withColumns({"path_key": path_key(F.col("path")), "ingest_at": F.lit(ingest_at), "path": redacted(F.col("path"), rules) if scope == "strict" else F.col("path")})
        tables = derive(recs, chosen.drop("source_ord", "modified", "late"), rules, scope)
        tables = with_changes(store, tables, f"{work}/changes", on_change == "replace")
        store.publish(tables | {"ingest_log": rows}, batch_id, on_change == "replace")
        store.tidy()
    finally:
        fs, path = store._fs(work)
        fs.delete(path, True)
    return store.read("ingest_log").where(F.col("ingest_at") == ingest_at)


def delete_sessions(store: Store, keys: DataFrame) -> None:
    """Deletes the sessions with these ids, and changes the rollups of their projects and the counts of their terms, in one step."""
    counted(store)
    state = store.current()
    gone = store.near("sessions", keys, state)
    if gone is not None:
        changes = taken_counts(gone, store.read("terms", state=state)) if "terms" in state["tables"] else {}
        store.delete(keys, changes | ({"projects": project_changes(store, state, None, gone)} if "projects" in state["tables"] else {}))


def counted(store: Store) -> None:
    """Makes the index of a store anew that has one, but none of the tables that are kept by changes."""
    state = store.current()
    if "postings" in state["tables"] and "term_cells" not in state["tables"]:
        rebuild_index(store)


def rebuild_index(store: Store) -> None:
    """Makes the postings, lengths, dictionary and counts of all stored sessions anew, in one step."""
    fields, work = search.fields_of(store.read("sessions")), f"{store.path}/_work/{uuid.uuid4().hex}"
    try:
        search.new_terms(fields).write.parquet(f"{work}/terms")
        terms = store.spark.read.schema("token string, term string").parquet(f"{work}/terms")
        search.postings(fields, dictionary=terms).write.parquet(f"{work}/postings")
        index, lengths = store.spark.read.schema(search.POSTINGS).parquet(f"{work}/postings").drop("bucket"), search.doc_stats(fields)
        topk.impacts(index, lengths).write.parquet(f"{work}/impacts")
        impacts = store.spark.read.parquet(f"{work}/impacts")
        store.rebuild({"postings": index, "impacts": impacts, "doc_stats": lengths, "terms": terms, "term_counts": search.term_counts(index, lengths), "term_cells": topk.term_cells(impacts)})
    finally:
        fs, path = store._fs(work)
        fs.delete(path, True)


FOUND = "session_uuid string, project_name string, ai_title string, started_at string, duration_secs long, git_branch string, snippet string, rank double"


def find(store: Store, query: str, limit: int = 20, now: datetime | None = None, column: str = "user_messages", **filters) -> DataFrame:
    """A question put to the store: the best sessions that hold all its phrases and pass the filters of lists.matching.

    All is read from one state; of postings and counts only the buckets of the question's terms. A question of single terms reads only
    what can be among the best (topk.best); how many sessions hold a phrase of several terms tells only a look at all of them. Filters need few and
    narrow columns; the rows of the at most 100 best, with the text that the snippet is cut from, are fetched from the buckets of their ids. Ties go by id.
    """
    state, most = store.current(), min(100, max(1, limit))
    phrases = search.phrases_of(query, search.Analysis())
    terms = sorted({t for p in phrases for t in p})
    if not terms or "sessions" not in state["tables"]:
        return store.spark.createDataFrame([], FOUND)
    passed = None
    if any(filters.values()):
        passed = lists.matching(store.read("sessions", state=state), now or datetime.now(timezone.utc), **filters).select("session_uuid")
    counts = store.read("term_counts", ["", *terms], state)
    if all(len(p) == 1 for p in phrases) and "term_cells" in state["tables"]:
        cells = store.read("term_cells", terms, state).selectExpr("term", "cell", "n", "0L AS tokens")
        cells = cells.unionByName(counts.where("term = ''").selectExpr("term", "0 AS cell", "n", "tokens"))

        def live(rows):
            if isinstance(rows, DataFrame):
                return rows.join(store.read("doc_stats", state=state).select("session_uuid", "batch"), ["session_uuid", "batch"], "left_semi")
            ids = [r.session_uuid for r in rows]
            known = {(r.session_uuid, r.batch) for r in store.read("doc_stats", ids, state).collect()} if ids else set()
            return [r for r in rows if (r.session_uuid, r.batch) in known]

        best = {i: rank for rank, i in topk.best(store.read("impacts", terms, state), cells, [p[0] for p in phrases], most, live, passed)}
    else:
        ranks = search.ranked(store.read("postings", terms, state), store.read("doc_stats", state=state), query, counts=counts)
        top = ranks if passed is None else ranks.join(passed, "session_uuid")
        best = {r.session_uuid: r["rank"] for r in top.orderBy("rank", "session_uuid").limit(most).collect()}
    if not best:
        return store.spark.createDataFrame([], FOUND)
    rank = F.element_at(F.from_json(F.lit(json.dumps(best)), "map<string,double>"), F.col("session_uuid"))
    rows = store.read("sessions", list(best), state).withColumn("rank", rank)
    return search.shown(rows, query, column=column).orderBy("rank", "session_uuid")


def outcome_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count("*").alias("files"))
