"""Parsing, ingest and export over hand-written session files."""

import json
import re

import pytest
from pyspark.sql import functions as F

from sessionloom.functions.text import tool_result_text
from sessionloom.operators import anonymise, export, redact, search
from sessionloom.operators.tables import Store, orphans
from sessionloom.plans import parsing
from sessionloom.plans.ingest import ingest_available, outcome_counts
from sessionloom.sources.sessions import Source, scan_files, split_lines

AT = "2026-01-01T00:00:00Z"


def user(text, **more):
    return {"type": "user", "sessionId": "s1", "uuid": "u1", "timestamp": "2026-01-01T10:00:00Z", "cwd": "/home/x/proj", "gitBranch": "main", "message": {"content": [{"type": "text", "text": text}]}} | more


def assistant(*content, **more):
    return {"type": "assistant", "sessionId": "s1", "uuid": "a1", "timestamp": "2026-01-01T10:01:30Z", "message": {"content": list(content), "usage": {"input_tokens": 3, "output_tokens": 5}}} | more


def session(tmp_path, name, *records, folder="-home-x-proj"):
    d = tmp_path / folder
    d.mkdir(parents=True, exist_ok=True)
    (d / name).write_bytes(b"\n".join(r if isinstance(r, bytes) else json.dumps(r).encode() for r in records))


def folded(spark, tmp_path):
    recs = parsing.records(split_lines(scan_files(spark, [Source("a", str(tmp_path))])))
    return recs, parsing.sessions(recs, AT)


def test_fold(spark, tmp_path):
    session(tmp_path, "s.jsonl",
        {"type": "queue-operation", "operation": "enqueue", "timestamp": "2026-01-01T09:59:00Z", "sessionId": "s1"}, user("meta", isMeta=True, cwd="/other", timestamp="2026-01-01T01:00:00Z"), user("  fix the bug  "),
        assistant({"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "t", "name": "Write", "input": {"file_path": "/b.py"}}, {"type": "tool_use", "id": "t2", "name": "Agent", "input": {}}),
        {"type": "ai-title", "aiTitle": "First", "sessionId": "s1"}, {"type": "ai-title", "aiTitle": None, "sessionId": "s1"},
        {"type": "file-history-snapshot", "snapshot": {"trackedFileBackups": {"/a.py": {}}}}, user("plain", uuid="u2", message={"content": "[1]"}), b"", b"null", b'{"type":"odd"}', b'{"type":"user"} x', b'{"half', b"\xff",
    )
    recs, s = folded(spark, tmp_path)
    row = s.first()
    assert (row.session_uuid, row.cwd, row.project_name, row.git_branch) == ("s1", "/home/x/proj", "proj", "main")
    assert (row.started_at, row.ended_at, row.duration_secs) == ("2026-01-01T09:59:00Z", "2026-01-01T10:00:00Z", 60)
    assert (row.message_count, row.user_message_count, row.tool_use_count, row.input_tokens, row.output_tokens) == (3, 2, 2, 3, 5)
    assert row.ai_title is None and row.has_subagents and row.tools_used == ["Agent", "Write"] and row.files_modified == ["/a.py", "/b.py"]
    assert row.user_messages == "  fix the bug  " and row.summary == "Untitled session. fix the bug. Files: a.py, b.py. Tools: Agent, Write"
    assert [e.split(":")[0] for e in row.parse_errors] == ["line 10", "line 11", "line 12", "line 13", "line 14"]
    m = {r.uuid: r for r in parsing.messages(recs, s).collect()}
    assert m["a1"].has_thinking and m["a1"].tool_names == ["Write", "Agent"] and json.loads(m["a1"].content_json)[0] == {"type": "thinking", "omitted": True}
    assert m["u2"].content_json == "[]"
    text = export.markdown(s, parsing.messages(recs, s), parsing.blocks(recs, s)).first()
    assert "**🔧 Write**" in text.markdown and '  "file_path": "/b.py"' in text.markdown and text.filename == "s1-2026-01-01.md"


def test_cleaned_transcript(spark, tmp_path):
    picture = {"type": "image", "source": {"type": "base64", "media_type": "image/gif", "data": "SECRET"}}
    result = {"type": "tool_result", "tool_use_id": "t", "is_error": False, "content": ["bare", {"type": "text", "text": 'an "image"'}, picture]}
    session(tmp_path, "s.jsonl", user("x", extra={"k": [1, "é"]}, message={"role": "user", "content": [picture, "[bare]", None, result, {"type": "tool_result", "content": 'no "image" here'}]}), user("y", uuid="u2"))
    recs, s = folded(spark, tmp_path)
    gone = {"type": "image", "omitted": True, "media_type": "image/gif"}
    want = [gone, "[bare]", None, result | {"content": [*result["content"][:2], gone]}, {"type": "tool_result", "content": 'no "image" here'}]
    first, second = map(json.loads, parsing.raw_transcripts(recs, s).first().raw_jsonl.split("\n"))
    assert first == user("x", extra={"k": [1, "é"]}, message={"role": "user", "content": want}) and second == user("y", uuid="u2")
    assert json.loads(parsing.messages(recs, s).where("uuid = 'u1'").first().content_json) == want
    kept = parsing.records(split_lines(scan_files(spark, [Source("a", str(tmp_path))])), nested_images=True)
    assert json.loads(parsing.messages(kept, s).where("uuid = 'u1'").first().content_json)[3] == result


def test_anonymised(spark, tmp_path):
    session(tmp_path, "s.jsonl", user("fix CORS now", message={"content": "about auth and CORS"}), user("m", isMeta=True, uuid="u9"), {"type": "file-history-snapshot", "snapshot": {"trackedFileBackups": {"/z.py": {"v": 3}, "": {}}}},
        assistant({"type": "text", "text": ""}, {"type": "tool_use", "id": "t", "name": "Write", "input": {"file_path": "/b.py", "content": "private"}}, {"type": "tool_use", "id": "t", "name": "Edit", "input": {"path": "/z.py"}}, {"type": "thinking", "thinking": "hm"}),
        {"type": "ai-title", "aiTitle": "The CORS plan", "sessionId": "s1"}, {"type": "last-prompt", "lastPrompt": "private", "sessionId": "s1"}, b"{bad",
    )
    recs, s = folded(spark, tmp_path)
    out = [json.loads(r.line) for r in anonymise.anonymised(recs, ("auth", "CORS"), "/home/x/", "/home/safe/").orderBy("line_no").collect()]
    assert [o["type"] for o in out] == ["user", "user", "file-history-snapshot", "assistant", "ai-title", "last-prompt"]
    assert out[0]["message"]["content"] == [{"type": "text", "text": "(text left out, it names: CORS, auth)"}] and out[0]["cwd"] == "/home/safe/proj"
    assert "message" not in out[1] and out[2]["snapshot"] == {"trackedFileBackups": {"files/file-01.txt": {"version": 1}}}
    assert [b.get("input", {}).get("file_path") for b in out[3]["message"]["content"]] == [None, "files/file-02.txt", "files/file-01.txt", None]
    assert out[3]["message"]["usage"] == {"input_tokens": 3, "output_tokens": 5} and "CORS" in out[4]["aiTitle"] and "private" not in json.dumps(out)


def test_ingest_twice_is_ingest_once(spark, tmp_path):
    files, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    session(files, "a.jsonl", user("hello token: " + "a" * 44))
    session(files, "b.jsonl", user("again"), folder="-other")
    session(files, "c.jsonl", {"type": "last-prompt", "lastPrompt": "x"}, folder="-none")
    session(files, "d.jsonl", user("side"), folder="-p/subagents")
    sources = [Source("s", str(files)), Source("off", "/nowhere", enabled=False)]
    first = {r.status: r.files for r in outcome_counts(ingest_available(spark, store, sources, AT)).collect()}
    assert first == {"ok": 1, "skipped": 1, "error": 1}
    assert store.read("sessions").count() == 1 and "[REDACTED]" in store.read("sessions").first().user_messages
    ingest_available(spark, store, sources, "2026-01-02T00:00:00Z")
    assert store.read("sessions").count() == 1 and orphans(store.read("messages"), store.read("sessions")).count() == 0
    session(files, "a.jsonl", user("changed"))
    ingest_available(spark, store, sources, "2026-01-03T00:00:00Z", on_change="replace")
    assert [r.user_messages for r in store.read("sessions").collect()] == ["changed"]
    store.delete(store.read("sessions"))
    assert store.read("sessions").count() == 0


@pytest.mark.parametrize("text", ["sk-ant-" + "a" * 60, "sk-" + "b" * 40, "x Bearer " + "c" * 20 + "." + "d" * 5, "PASSWORD= longenough1", "-----BEGIN DSA PRIVATE KEY-----\nx\n-----END DSA PRIVATE KEY-----", "mysql://abcdefgh", "nothing here", "token: short"])
def test_rules_match_python(spark, text):
    want = text
    for r in redact.RULES:
        want = re.sub(r.pattern, r.replacement, want)
    got = redact.redact(spark.createDataFrame([(text,)], "summary string")).first()[0]
    assert got == want


def test_search(spark):
    s = spark.createDataFrame([("a", "Fees: fee-to-enrollment café running"), ("b", "enrollment to fee. cafe"), ("c", None)], "session_uuid string, user_messages string")
    fields = search.fields_of(s)
    index, docs = search.postings(fields), search.doc_stats(fields)
    hits = lambda q: [r.session_uuid for r in search.ranked(index, docs, q).orderBy("session_uuid").collect()]
    assert hits("fee-to-enrollment") == ["a"] and hits("cafe fee") == ["a", "b"] and hits("runs") == ["a"] and hits("!!") == [] and hits("") == []


def test_ranks_like_fts5(spark):
    import random
    import sqlite3

    random.seed(3)
    docs = [(str(i), " ".join(random.choice("alpha beta gamma delta eps".split()) for _ in range(random.randint(1, 30)))) for i in range(40)]
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, x, tokenize='porter unicode61')")
    c.executemany("INSERT INTO t VALUES (?, ?)", docs)
    want = dict(c.execute("SELECT id, rank FROM t WHERE t MATCH '\"alpha\" \"beta gamma\"'"))
    fields = search.fields_of(spark.createDataFrame(docs, "session_uuid string, user_messages string"))
    got = {r.session_uuid: r["rank"] for r in search.ranked(search.postings(fields), search.doc_stats(fields), "alpha beta-gamma").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_plain_string_prompts_as_text(spark):
    lines = [("a", "/p/x.jsonl", "p", i + 1, json.dumps({"type": "user", "sessionId": "s", "uuid": f"u{i}", "timestamp": AT, "message": {"content": c}})) for i, c in enumerate(["plain \"prompt\"", "[1]", [{"type": "text", "text": "block"}], None, 5, ""])]
    df = spark.createDataFrame(lines, "source_id string, path string, project_dir string, line_no int, line string")
    drop, text = (parsing.sessions(parsing.records(df, string_content=c), AT).first() for c in ("drop", "text"))
    assert drop.user_messages == "block" and text.user_messages == "plain \"prompt\"\n\n[1]\n\nblock\n\n" and "plain" in text.summary and text.message_count == 6
    with pytest.raises(ValueError):
        parsing.records(df, string_content="other")


@pytest.mark.parametrize("content, want", [(["{bare", "x", 5], "{bare\nx"), ([{"text": "a"}, "", True, None, {"text": None}, {"n": 1}, ["y"], "b"], "a\nb"), ("[1]", "[1]"), (None, ""), ({"k": 1}, '{"k":1}'), ([], "")])
def test_tool_result_texts(spark, content, want):
    line = json.dumps({"type": "user", "sessionId": "s", "uuid": "u", "message": {"content": [{"type": "tool_result", "tool_use_id": "t", "content": content}]}})
    recs = parsing.records(spark.createDataFrame([("a", "/p/x.jsonl", "p", 1, line)], "source_id string, path string, project_dir string, line_no int, line string"))
    blocks = parsing.blocks(recs, parsing.sessions(recs, AT))
    assert [r[0] for r in blocks.select(tool_result_text(F.col("result"), F.col("result_listed"))).collect()] == [want]
