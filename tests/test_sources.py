"""Files in byte ranges against whole files, and which files a batch opens."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sessionloom.operators.tables import Store
from sessionloom.plans import ingest
from sessionloom.sources import sessions
from sessionloom.sources.sessions import Source

from .test_sessions import AT, user


def source(tmp_path):
    return [Source("a", str(tmp_path / "in"))]


def write(tmp_path, name, data, folder="-p"):
    at = tmp_path / "in" / folder / name
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(data if isinstance(data, bytes) else json.dumps(data).encode())
    return at


@pytest.fixture(params=["61b"])
def narrow(spark, request):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, request.param)
    yield
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def test_ranges_are_the_whole_file(spark, tmp_path, narrow):
    rng = random.Random(5)
    parts = [b"\n", b"\r\n", b"\r", b"ab", "é日".encode(), b"\xff", b"\xe2\x82", b"x" * 40, b" ", " ".encode()]
    for i, name in enumerate(["a.jsonl", "b c+d%20é.jsonl", "[e]{f}*.jsonl", "g.jsonl", "h.jsonl"]):
        write(tmp_path, name, b"".join(rng.choices(parts, k=60 + 60 * i)) + b"end")
    files = sessions.scan_files(spark, source(tmp_path))
    whole = {(r.path, r.line_no): r.line for r in sessions.split_lines(files).collect()}
    rows = sessions.range_lines(spark, files, str(tmp_path / "work"))
    assert spark.read.parquet(str(tmp_path / "work")).select("path", "start").distinct().count() > 12
    assert {(r.path, r.line_no): r.line for r in rows.collect()} == whole and rows.count() == len(whole)
    assert {(r.source_id, r.project_dir) for r in rows.collect()} == {("a", "-p")}


def test_streamed_hashes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sessions, "CHUNK", 3)
    made = {f"{i} é+.jsonl": os.urandom(i * 5) for i in range(1, 5)}
    for name, data in made.items():
        write(tmp_path, name, data)
    got = {r.path.rpartition("/")[2]: r.file_hash for r in sessions.hashed(sessions.list_files(spark, source(tmp_path))).collect()}
    assert got == {n: hashlib.sha256(d).hexdigest() for n, d in made.items()}


@pytest.mark.parametrize("named", [10_000, 1])
def test_only_files_to_take_in_are_opened(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(sessions, "NAMED", named)
    paths = [write(tmp_path, f"{i}.jsonl", user(f"text {i}", sessionId=f"s{i}")) for i in range(12)]
    for i, p in enumerate(paths):
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    store, opened = Store(spark, str(tmp_path / "store"), 2), []
    whole = ingest.read_files

    def watched(spark_, sources, wanted):
        found = whole(spark_, sources, wanted)
        opened.append({p.rpartition("/")[2] for p in found.select("content").inputFiles() if p.endswith(".jsonl")})
        return found

    monkeypatch.setattr(ingest, "read_files", watched)
    ingest.ingest_available(spark, store, source(tmp_path), AT)
    write(tmp_path, "0.jsonl", user("an old file changed, and older than all others", sessionId="new"))
    os.utime(paths[0], (1_600_000_000, 1_600_000_000))
    del opened[:]
    log = ingest.ingest_available(spark, store, source(tmp_path), "2026-01-02T00:00:00Z").collect()
    assert {r.status for r in log if r.path.endswith("/0.jsonl")} == {"ok"} and sum(r.reason == "file unchanged" for r in log) == 11
    assert opened == [{"0.jsonl"}] * 2
    assert store.read("sessions").count() == 13


@pytest.mark.parametrize("narrow", ["3000b"], indirect=True)
def test_large_files_go_in_ranges(spark, tmp_path, monkeypatch, narrow):
    rows = [user(f"line {i} é", sessionId="big", uuid=f"u{i}") for i in range(30)]
    write(tmp_path, "big.jsonl", "\r\n".join(json.dumps(r) for r in rows).encode() + b"\nno JSON\n")
    write(tmp_path, "small.jsonl", user("small", sessionId="small"))
    plain, ranged = Store(spark, str(tmp_path / "plain"), 2), Store(spark, str(tmp_path / "ranged"), 2)
    ingest.ingest_available(spark, plain, source(tmp_path), AT)
    monkeypatch.setattr(sessions, "LARGE", 1000)
    whole = ingest.read_files
    monkeypatch.setattr(ingest, "read_files", lambda s, x, wanted: whole(s, x, wanted) if not wanted.where("length > 1000").count() else pytest.fail("a large file as a row"))
    ingest.ingest_available(spark, ranged, source(tmp_path), AT)
    for table in ("sessions", "messages", "sessions_raw", "ingest_log"):
        a, b = ({json.dumps(json.loads(r[0]), sort_keys=True) for r in s.read(table).select(F.to_json(F.struct("*"))).collect()} for s in (plain, ranged))
        assert a == b, table
    assert plain.read("sessions", ["big"]).first().message_count == 30 and ranged.read("sessions", ["big"]).first().parse_errors[0].startswith("line 31:")
    again = ingest.ingest_available(spark, ranged, source(tmp_path), "2026-01-02T00:00:00Z").collect()
    assert {r.reason for r in again} == {"file unchanged"}
