"""Store, ingest and streams: buckets, replacing, compaction, waiting files, change feed and sinks."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import export, lists, redact, search
from sessionloom.operators.tables import Store, first_of_batch, orphans
from sessionloom.plans import parsing
from sessionloom.plans.ingest import delete_sessions, ingest_available, outcome_counts
from sessionloom.sources.sessions import Source, register_adapter, scan_files, split_lines
from sessionloom.streaming import live

from .test_sessions import AT, assistant, session, user


def put(files, name, text, sid, cwd="/home/x/proj", folder="-p"):
    session(files, name, user(text, sessionId=sid, cwd=cwd), folder=folder)


def folders(store, table):
    return {b: len(p) for b, p in store.current()["tables"][table]["buckets"].items()}


def test_replacing_writes_only_the_buckets_of_its_sessions(spark, tmp_path):
    files, store = tmp_path / "in", Store(spark, str(tmp_path / "store"), 8)
    for i in range(12):
        put(files, f"{i}.jsonl", f"text {i}", f"s{i}", f"/home/x/p{i % 2}")
    ingest_available(spark, store, [Source("a", str(files))], AT)
    before = store.current()["tables"]["messages"]["buckets"]
    put(files, "3.jsonl", "changed words", "s3", "/home/x/p9")
    log = ingest_available(spark, store, [Source("a", str(files))], "2026-01-02T00:00:00Z", on_change="replace")
    assert {r.status: r.files for r in outcome_counts(log).collect()} == {"ok": 1, "skipped": 11}
    assert {r.reason for r in log.where("status = 'skipped'").collect()} == {"file unchanged"}
    after = store.current()["tables"]["messages"]["buckets"]
    assert sum(before[b] != after.get(b) for b in before) == 1
    assert store.read("sessions").count() == 12 and store.read("sessions", ["s3"]).first().user_messages == "changed words"
    assert orphans(store.read("messages"), store.read("sessions")).count() == 0 and store.read("sessions_raw").count() == 12
    projects = {r.project_name: r.session_count for r in store.read("projects").collect()}
    assert projects == {"p0": 6, "p1": 5, "p9": 1}
    hits = lambda q: {r.session_uuid for r in search.ranked(store.read("postings"), store.read("doc_stats"), q).collect()}
    assert hits("changed") == {"s3"} and "s3" not in hits("text") and len(hits("text")) == 11
    stale = store.read("postings").where("session_uuid = 's3'").count()
    assert "postings" in store.compact(0) and store.read("postings").where("session_uuid = 's3'").count() < stale and hits("changed") == {"s3"}
    assert set(folders(store, "sessions").values()) == {1}
    delete_sessions(store, spark.createDataFrame([("s3",), ("s1",), ("none",)], "session_uuid string"))
    assert store.read("sessions").count() == 10 and store.read("messages").count() == 10 and hits("changed") == set()
    assert {r.project_name: r.session_count for r in store.read("projects").collect()} == {"p0": 6, "p1": 4}
    assert {r.session_uuid for r in search.ranked(store.read("postings", ["text"]), store.read("doc_stats"), "text").collect()} == {f"s{i}" for i in range(12) if i not in (1, 3)}


def test_a_second_writer_fails_and_readers_see_whole_batches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 2)
    rows = spark.createDataFrame([("a", 1)], "session_uuid string, n int")
    assert store.read("sessions") is None and store.publish({"sessions": rows}, "b1") and not store.publish({"sessions": rows}, "b1")
    state = store.current()
    store._commit(state)
    with pytest.raises(RuntimeError, match="first"):
        store._commit(state)
    (tmp_path / "s" / "_state" / "_half").write_text("{")
    assert store.read("sessions").count() == 1 and store.current()["version"] == 2
    more = spark.createDataFrame([("b", 2, "x")], "session_uuid string, n int, extra string")
    store.publish({"sessions": more})
    assert sorted((r.session_uuid, r.extra) for r in store.read("sessions").collect()) == [("a", None), ("b", "x")]
    for _ in range(25):
        store._commit(store.current())
    assert len([n for n in os.listdir(tmp_path / "s" / "_state") if n.endswith(".json")]) == store.VERSIONS


def test_files_that_change_wait_but_not_for_ever(spark, tmp_path):
    files, store, sources = tmp_path / "in", Store(spark, str(tmp_path / "store")), [Source("a", str(tmp_path / "in"))]
    put(files, "a.jsonl", "one", "s1")
    quiet = {"quiet_before": "2000-01-01T00:00:00Z"}
    log = ingest_available(spark, store, sources, "2026-01-01T00:00:00Z", **quiet)
    assert [(r.status, r.reason) for r in log.collect()] == [("waiting", "still changing")] and store.read("sessions").count() == 0
    log = ingest_available(spark, store, sources, "2026-01-01T00:00:10Z", **quiet)
    assert [r.status for r in log.collect()] == ["waiting"]
    log = ingest_available(spark, store, sources, "2026-01-01T00:00:15Z", **quiet)
    assert [(r.status, r.reason) for r in log.collect()] == [("ok", "taken while still changing")] and store.read("sessions").count() == 1


def test_same_content_elsewhere_is_passed_over(spark, tmp_path):
    files, store, sources = tmp_path / "in", Store(spark, str(tmp_path / "store")), [Source("a", str(tmp_path / "in"))]
    put(files, "a.jsonl", "one", "s1")
    ingest_available(spark, store, sources, AT)
    put(files, "copy.jsonl", "one", "s1", folder="-q")
    os.utime(files / "-q" / "copy.jsonl", (1, 1))  # moved here with an old time
    log = ingest_available(spark, store, sources, "2026-01-02T00:00:00Z")
    assert sorted(r.reason for r in log.collect()) == ["file unchanged", "file_hash already indexed"]
    assert ingest_available(spark, store, sources, "2026-01-03T00:00:00Z").count() == 2 and not os.listdir(tmp_path / "store" / "_work")


def test_session_files_stream_into_the_store(spark, tmp_path):
    files, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    put(files, "a.jsonl", "one", "s1")
    put(files, "b.jsonl", "later file of one session", "s1", folder="-q")
    put(files, "n.jsonl", "x", "s2", folder="-p/subagents")
    stream = lambda: live.session_files(spark, Source("a", str(files)))
    live.capture(stream(), store, str(tmp_path / "check"), AT).awaitTermination()
    assert [r.session_uuid for r in store.read("feed").collect()] == ["s1"] and store.read("sessions").first().user_messages == "one"
    assert store.read("sessions_raw").count() == 1 and store.read("postings").count() > 0
    put(files, "c.jsonl", "two", "s3", folder="-new/deep")
    query = live.backfill_then_follow(stream, store, str(tmp_path / "check"), AT, "1 second")
    assert sorted(r.session_uuid for r in store.read("feed").collect()) == ["s1", "s3"]
    put(files, "d.jsonl", "three", "s4")
    for _ in range(60):
        query.processAllAvailable()
        if store.read("sessions").count() == 3:
            break
        time.sleep(1)
    query.stop()
    assert sorted(r.session_uuid for r in store.read("sessions").collect()) == ["s1", "s3", "s4"]


def test_each_session_once_in_a_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:05:00")]
    spark.createDataFrame(rows, "session_uuid string, at string").select("session_uuid", F.to_timestamp("at").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("session_uuid string, ts timestamp").parquet(str(tmp_path / "e"))
    got = live.run_to_rows(live.once_per_session(stream), "append")
    assert sorted(r.session_uuid for r in got.collect()) == ["a", "b"]


def test_first_of_batch(spark):
    rows = [("k", 2, "a", 1), ("k", 1, "z", 2), ("k", 1, "b", 3), (None, 1, "c", 4), (None, 0, "d", 5)]
    got = first_of_batch(spark.createDataFrame(rows, "session_uuid string, source_ord int, path string, n int"))
    assert {(r.session_uuid, r.n) for r in got.collect()} == {("k", 3), (None, 5)}


@pytest.mark.parametrize("line", ['{"type":"user"}', '{"a":1} x', '{"a":1}, {"b":2}', '{"a":1}],[{}', '{"a":1},"line":2', '{"a":NaN}', "{half", "[1]", "1", '"x"', '{"a":1}}', "nul", " ", '{"a": "\\ud800"}', '{"a":1,"a":2}', '{"a":"tab\there"}', '﻿{"a":1}'])
def test_lines_are_judged_as_python_judges_them(spark, line):
    from sessionloom.functions.text import json_error

    got = spark.createDataFrame([(line,)], "line string").select(json_error(F.col("line"))).first()[0]
    try:
        json.loads(line) if line.strip() else None
        assert got is None
    except ValueError as e:
        assert got == str(e)


def test_tool_results_that_look_like_lists(spark, tmp_path):
    results = ['["a","b"]', ["a", {"type": "text", "text": "b"}, {"type": "image"}, ""], None, {"k": 1}, "", 7]
    session(tmp_path, "s.jsonl", user("x"), assistant(*[{"type": "tool_result", "tool_use_id": str(i), "content": c} for i, c in enumerate(results)]))
    recs = parsing.records(split_lines(scan_files(spark, [Source("a", str(tmp_path))])))
    s = parsing.sessions(recs, AT)
    blocks = parsing.blocks(recs, s)
    from sessionloom.functions.text import tool_result_text

    got = [r[0] for r in blocks.where("block_type = 'tool_result'").orderBy("block_idx").select(tool_result_text(F.col("result"), F.col("result_listed"))).collect()]
    assert got == ['["a","b"]', "a\nb", "", '{"k":1}', "", "7"]
    text = export.markdown(s, parsing.messages(recs, s), blocks).first().markdown
    assert text.count("**↳ tool result**") == 4 and '```\n["a","b"]\n```' in text and "```\na\nb\n```" in text


WHOLE = """# The title

## Metadata

- **Project:** `proj`
- **Branch:** `main`
- **CWD:** `/home/x/proj`
- **Started:** 2026-01-01T10:00:00Z
- **Duration:** 0h 1m
- **Session UUID:** `s1`
- **Tools used:** `Bash`

## Conversation

### 👤 User  _2026-01-01T10:00:00Z_

hello

---

### 🤖 Claude  _2026-01-01T10:01:30Z_

> _[thinking block omitted]_

**🔧 Bash**

```json
{
  "command": "ls"
}
```

---
"""


def test_markdown_and_json_sinks(spark, tmp_path):
    session(tmp_path / "in", "s.jsonl", user("hello"), assistant({"type": "thinking", "thinking": "x"}, {"type": "tool_use", "name": "Bash", "id": "t", "input": {"command": "ls"}}, {"type": "odd"}), {"type": "ai-title", "aiTitle": "The title", "sessionId": "s1"})
    recs = parsing.records(split_lines(scan_files(spark, [Source("a", str(tmp_path / "in"))])))
    s = parsing.sessions(recs, AT)
    documents = export.markdown(s, parsing.messages(recs, s), parsing.blocks(recs, s))
    assert documents.first().markdown == WHOLE
    twin = documents.withColumns({"session_uuid": F.lit("a/b"), "markdown": F.lit("other")})
    odd = documents.withColumns({"session_uuid": F.lit("c"), "filename": F.lit('../x:"y.md'), "markdown": F.lit("third")})
    written = export.write_markdown(documents.unionByName(twin).unionByName(odd), f"file://{tmp_path}/out")
    names = sorted(n for n in os.listdir(tmp_path / "out") if n.endswith(".md"))
    assert names == sorted(r.filename for r in written.collect()) == ["..-x--y.md", "s1-2026-01-01-a-b.md", "s1-2026-01-01-s1.md"]
    assert (tmp_path / "out" / "s1-2026-01-01-s1.md").read_text() == WHOLE
    rows = spark.createDataFrame([("a", None, 1.5)], "session_uuid string, `a.b` string, rank double")
    assert [json.loads(r.json) for r in export.as_json(rows).collect()] == [{"session_uuid": "a", "a.b": None, "rank": 1.5}]


def test_rule_files(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"rules": [{"name": "a", "pattern": "x+", "replacement": "y"}, {"name": "half"}, {"name": "bad", "pattern": "(", "replacement": ""}]}))
    rules = redact.load_rules(spark, str(path))
    assert [r.name for r in rules] == ["a"] and redact.redact(spark.createDataFrame([("axxb",)], "summary string"), rules=rules).first()[0] == "ayb"
    path.write_text("no json")
    assert redact.load_rules(spark, str(path)) == redact.RULES == redact.load_rules(spark) == redact.load_rules(spark, str(tmp_path / "none"))


def test_other_source_kinds(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("hello")
    register_adapter("plain", lambda files: split_lines(files).withColumn("line", F.format_string('{"type":"user","sessionId":"p","message":{"content":[{"type":"text","text":"%s"}]}}', "line")))
    store = Store(spark, str(tmp_path / "store"))
    ingest_available(spark, store, [Source("a", str(tmp_path), "plain"), Source("b", str(tmp_path), "unknown")], AT)
    assert [(r.source_id, r.user_messages) for r in store.read("sessions").collect()] == [("a", "hello")]


def test_pages_and_filters(spark):
    rows = [(f"s{i}", f"2024-01-{i + 1:02d}T00:00:00Z", ["Bash", "WebFetch"] if i % 2 else ["Read"]) for i in range(9)]
    s = spark.createDataFrame(rows, "session_uuid string, started_at string, tools_used array<string>").withColumn("started_ts", F.to_timestamp("started_at"))
    from datetime import datetime

    now = datetime(2024, 1, 9)
    first = [r.session_uuid for r in lists.page(s, 4, 0, now=now).collect()]
    after = [r.session_uuid for r in lists.page_after(s, "2024-01-06T00:00:00Z", "s5", 4, now=now).collect()]
    assert first == ["s8", "s7", "s6", "s5"] and after == ["s4", "s3", "s2", "s1"]
    assert lists.count(s, now=now, tool="fetch", tool_match="substring").first().total == 4 and lists.count(s, now=now, tool="fetch").first().total == 0
    assert [lists.since_days(x) for x in ("30d", " 7d ", None, "x", "2024-01-01")] == [30, 7, 365, 365, 365]
    assert lists.count(s, now=now, since=" ", until="2024-01-02", compare="text").first().total == 1


def test_search_results_and_stored_index(spark, tmp_path):
    rows = [(f"s{i}", "p", None, f"2024-01-{i + 1:02d}", 5, "main", f"word{i % 3} common tail{i}") for i in range(9)]
    s = spark.createDataFrame(rows, "session_uuid string, project_name string, ai_title string, started_at string, duration_secs long, git_branch string, user_messages string")
    search.write_index(search.fields_of(s), str(tmp_path / "i"))
    whole, stats = search.read_index(spark, str(tmp_path / "i"))
    index, _ = search.read_index(spark, str(tmp_path / "i"), "word1 common")
    assert index.select("term").distinct().count() < whole.select("term").distinct().count()
    got = search.search(s, index, stats, "word1 common", 2).collect()
    assert [r.session_uuid for r in got] == ["s1", "s4"] and got[0].snippet == "<mark>word1</mark> <mark>common</mark> tail1" and got[0].project_name == "p"
    assert search.read_index(spark, str(tmp_path / "i"), "--")[0].count() == 0
    plan = index.where("term = 'common'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[-1]


def test_stems_and_snippets_like_fts5(spark):
    import random
    import sqlite3

    random.seed(5)
    words = "connection relational hopping happily generalizations agreed running ponies sky feed plastered failing oscillators rationalize dependent adoption replacement".split()
    texts = [" ".join(random.choice([*words, "the.", "End:"]) for _ in range(random.randint(3, 60))) for _ in range(80)]
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    c.executemany("INSERT INTO t VALUES (?)", [(t,) for t in texts])
    analysis = search.Analysis()
    for query in ("connect relate", "hop", "running-the", "depend feed ponies"):
        phrases = search.phrases_of(query, analysis)
        fts = " ".join('"' + p.replace("-", " ") + '"' for p in query.split())
        for rowid, want in c.execute("SELECT rowid, snippet(t, 0, '<mark>', '</mark>', '...', 15) FROM t WHERE t MATCH ?", (fts,)).fetchall():
            assert search.snippet(texts[rowid - 1], phrases, analysis) == want
