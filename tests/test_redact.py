"""Secrets in every field: JSON stays JSON, no stored column keeps one, and texts are cut only after redaction."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionloom.operators import redact
from sessionloom.operators.tables import Store
from sessionloom.plans.ingest import ingest_available
from sessionloom.plans.registry import SECRETS
from sessionloom.sources.sessions import Source
from sessionloom.streaming import live

from .test_sessions import AT

KEY = "AKIA" + "Q7" * 8
PARTS = [*SECRETS, KEY, "password=hunter2hunter2", "token: " + "t" * 40, "postgresql://u:pw1@h", "x", ' "', "\n", "é", "\\", "sk-", "secret", " = ", "-----BEGIN ", "Bearer  ", "mysql://abc defghij", "aws secret\r= " + "k" * 40]
TEXT = st.lists(st.sampled_from(PARTS), max_size=4).map("".join)
VALUE = st.recursive(st.one_of(TEXT, st.none(), st.integers(), st.floats(allow_nan=False), st.booleans()), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(TEXT, x, max_size=3)), max_leaves=8)


def chain(text):
    for r in redact.RULES:
        text = r.python().sub(r.replacement, text)
    return text


def expected(value, key=None):
    if isinstance(value, str):
        pair = f'"{key}": "{value}"'
        return "[REDACTED]" if chain(value) == value and key is not None and chain(pair) != pair else chain(value)
    if isinstance(value, list):
        return [expected(v) for v in value]
    if isinstance(value, dict):
        return [(chain(k), expected(v, k)) for k, v in value.items()]
    return value


@settings(max_examples=300, deadline=None)
@given(VALUE, st.booleans(), st.sampled_from([None, 1]))
def test_strings_of_json_are_redacted_in_place(value, ascii_only, indent):
    text = json.dumps(value, ensure_ascii=ascii_only, indent=indent)
    got = redact.json_redactor()(text)
    assert as_pairs(json.loads(got, object_pairs_hook=Pairs)) == json.loads(json.dumps(expected(value)))
    assert redact.json_redactor(())(text) == text


class Pairs(list):
    pass


def as_pairs(value):
    if isinstance(value, Pairs):
        return [[k, as_pairs(v)] for k, v in value]
    return [as_pairs(v) for v in value] if isinstance(value, list) else value


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=8).map("".join))
def test_hints_hide_no_match(text):
    assert redact.text_redactor()(text) == chain(text)


def test_columns_match_python(spark):
    texts = [a + b for a in PARTS for b in PARTS] + ["", None]
    docs = [t and json.dumps({"a": [t, {"auth": "dXNlcjpwYXNzd29yZDEyMw=="}], "k": 1.0}, ensure_ascii=bool(i % 2)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(list(zip(texts, docs)), "t string, j string").select(redact.redacted(F.col("t")).alias("t"), redact.json_redacted(F.col("j")).alias("j"))
    rows = df.collect()
    assert [r.t for r in rows] == [t if t is None else chain(t) for t in texts]
    for r, t in zip(rows, texts):
        assert (r.j or None) is None if not t else json.loads(r.j) == {"a": [chain(t), {"auth": "[REDACTED]"}], "k": 1.0} and '"k": 1.0' in r.j


def test_dots_end_where_javas_do():
    assert not redact.Rule("a", r"x.y[.]\.", "").python().search("x\ry..") and redact.Rule("a", r"x.y[.]\.", "").python().search("x-y..")


def lines():
    k = lambda name: f"{name} {KEY} end"
    common = {"timestamp": "2026-01-01T00:00:00Z", "sessionId": k("sid"), "cwd": k("/home/x"), "gitBranch": k("branch"), "slug": k("slug"), "entrypoint": k("entry"), "version": k("v"), "permissionMode": k("mode"), "extra": {k("key"): [k("deep")]}}
    call = {"type": "tool_use", "id": k("call"), "name": k("Tool"), "input": {"file_path": k("/f"), "cmd": "password=hunter2hunter2", "env": {"auth": "dXNlcjpwYXNzd29yZDEyMw=="}}}
    write = {"type": "tool_use", "id": "w", "name": "Write", "input": {"file_path": k("/written")}}
    result = {"type": "tool_result", "tool_use_id": k("call"), "content": [{"type": "text", "text": k("out")}, k("bare")]}
    image = {"type": "image", "source": {"media_type": k("image/png"), "data": k("data")}}
    yield json.dumps(common | {"type": "user", "uuid": k("u1"), "message": {"content": [{"type": "text", "text": "password=hunter2hunter2"}, {"type": "text", "text": k("prompt")}, image]}})
    yield json.dumps(common | {"type": "assistant", "uuid": k("u2"), "parentUuid": k("u1"), "message": {"content": [{"type": "text", "text": k("answer")}, {"type": "thinking", "thinking": k("t")}, call, write]}})
    yield json.dumps(common | {"type": "user", "uuid": "u3", "message": {"content": [result, {"type": "tool_result", "tool_use_id": "w", "content": k("text result")}]}})
    yield json.dumps(common | {"type": "user", "uuid": "u4", "isMeta": True, "message": {"content": k("meta")}})
    yield json.dumps({"type": "file-history-snapshot", "snapshot": {"trackedFileBackups": {k("/tracked"): {}}}})
    yield json.dumps({"type": "ai-title", "aiTitle": k("title"), "sessionId": k("sid")})
    yield json.dumps({"type": "last-prompt", "lastPrompt": k("last"), "sessionId": k("sid")})
    yield json.dumps({"type": k("odd")})
    yield "no JSON " + k("line") + ' {"'


def everything(store):
    for name in store.current()["tables"]:
        yield from ((name, json.loads(r[0])) for r in store.read(name).select(F.to_json(F.struct("*"))).collect())


def test_no_stored_column_keeps_a_secret(spark, tmp_path):
    folder = tmp_path / "in" / f"-p-{KEY}"
    folder.mkdir(parents=True)
    (folder / f"{KEY}.jsonl").write_text("\n".join(lines()))
    store, source = Store(spark, str(tmp_path / "store"), 2), [Source("a", str(tmp_path / "in"))]
    log = ingest_available(spark, store, source, AT).collect()
    assert [r.status for r in log] == ["ok"] and KEY not in str(log)
    rows = list(everything(store))
    assert {n for n, _ in rows} >= {"sessions", "messages", "blocks", "sessions_raw", "postings", "projects", "ingest_log"}
    for name, row in rows:
        assert not re.search(KEY + "|hunter2|dXNlcjpw", str(row), re.IGNORECASE), (name, row)
        if name == "messages":
            assert json.loads(row["content_json"]) is not None
        if name == "blocks" and row.get("tool_input"):
            assert json.loads(row["tool_input"])["file_path"].startswith("/")
        if name == "sessions_raw":
            raw = row["raw_jsonl"].split("\n")
            assert len(raw) == 9 and all(isinstance(json.loads(x), dict) for x in raw[:8]) and json.loads(raw[0])["extra"]
    s = store.read("sessions").first()
    assert "prompt" not in s.asDict() and s.message_count == 3 and s.cwd == "/home/x [REDACTED_AWS_KEY] end" and len(s.parse_errors) == 2 and s.session_uuid.startswith("redacted-")
    ids = {r.uuid: r.parent_uuid for r in store.read("messages").collect()}
    assert len(ids) == 3 and ids[[u for u, p in ids.items() if p][0]] in ids
    again = ingest_available(spark, store, source, "2026-01-02T00:00:00Z").collect()
    assert [r.reason for r in again] == ["file unchanged"]


def test_summaries_are_cut_after_redaction(spark):
    secret = "sk-ant-" + "a1" * 40
    made = []
    for at in range(20, 125, 5):
        sid = f"s{at:03d}"
        line = json.dumps({"type": "user", "uuid": "u", "sessionId": sid, "timestamp": "2026-01-01T00:00:00Z", "cwd": "/x", "message": {"content": [{"type": "text", "text": "y" * at + " " + secret + " z" * 60}]}})
        made.append(("a", f"/p/{sid}.jsonl", "p", 1, line))
    from sessionloom.plans import parsing
    from sessionloom.plans.ingest import read_records

    recs = read_records(spark.createDataFrame(made, "source_id string, path string, project_dir string, line_no int, line string"))
    rows = parsing.sessions(recs, AT).select("summary", "user_messages").collect()
    assert len(rows) == 21 and not any("a1a1" in str(r) for r in rows)


def test_compat_scope_and_streams(spark, tmp_path):
    folder = tmp_path / "in" / "-p"
    folder.mkdir(parents=True)
    (folder / "s.jsonl").write_text(json.dumps({"type": "user", "uuid": "u", "sessionId": "s1", "cwd": "/c/" + KEY, "timestamp": "2026-01-01T00:00:00Z", "message": {"content": [{"type": "text", "text": "see " + KEY}]}}))
    compat, stream = Store(spark, str(tmp_path / "c"), 2), Store(spark, str(tmp_path / "s"), 2)
    ingest_available(spark, compat, [Source("a", str(tmp_path / "in"))], AT, scope="compat")
    s = compat.read("sessions").first()
    assert KEY in s.cwd and s.user_messages == "see [REDACTED_AWS_KEY]" and KEY not in compat.read("sessions_raw").first().raw_jsonl
    live.capture(live.session_files(spark, Source("a", str(tmp_path / "in"))), stream, f"{tmp_path}/checkpoint", AT).awaitTermination()
    assert stream.read("sessions").count() == 1 and not any(KEY in str(r) for _, r in everything(stream))
