"""Questions put to the store, its index made anew, batch ids, compaction beside other writers, and cleaning up."""

import time
from datetime import datetime

import pytest

from sessionloom.operators import lists, search
from sessionloom.operators.tables import Conflict, Store
from sessionloom.plans.ingest import find, ingest_available, rebuild_index
from sessionloom.sources.sessions import Source

from .test_sessions import AT, assistant, session, user


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("questions")
    for i in range(9):
        call = {"type": "tool_use", "name": "Write" if i % 2 else "Read", "input": {"file_path": f"/f/{i}"}}
        stamp = f"2026-01-0{i + 1}T10:00:00Z"
        session(at / "in", f"{i}.jsonl", user("the fee to enrol " * (i + 1) + "Cafés running", sessionId=f"s{i}", cwd=f"/p/proj{i % 3}", timestamp=stamp), assistant({"type": "text", "text": "answer"}, call, sessionId=f"s{i}", timestamp=stamp), folder="-p")
    made = Store(spark, str(at / "store"), 4)
    ingest_available(spark, made, [Source("a", str(at / "in"))], AT)
    return made


def rows(df):
    return [(r.session_uuid, r.project_name, r.started_at, r.snippet, round(r["rank"], 9)) for r in df.collect()]


@pytest.mark.parametrize("query, filters", [("fee-to-enrol cafe", {}), ("run", {"project": "proj1"}), ("fee", {"tool": "Write", "since": "2026-01-03"}), ("fee", {"until": "2026-01-04", "branch": "main"}), ("nothing-here", {}), ("!!", {}), ("fee", {"project": "none"})])
def test_a_question_is_the_search_of_the_tables(store, query, filters):
    now = datetime(2026, 2, 1)
    plain = search.search(lists.matching(store.read("sessions"), now, **filters), store.read("postings"), store.read("doc_stats"), query, 5)
    got = rows(find(store, query, 5, now, **filters))
    assert got == sorted(rows(plain), key=lambda r: (r[4], r[0])) and all("<mark>" in r[3] for r in got)
    assert bool(got) == (query in ("fee-to-enrol cafe", "run", "fee") and filters.get("project") != "none")


def test_an_index_made_anew(store):
    before = rows(find(store, "fee cafe"))
    rebuild_index(store)
    assert rows(find(store, "fee cafe")) == before and len(before) == 9
    assert store.read("postings").select("batch").distinct().count() == 1


def test_batches_compaction_and_cleaning(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), 2)
    row = lambda k: {"sessions": spark.createDataFrame([(k, 1)], "session_uuid string, n int")}
    monkeypatch.setattr(Store, "BATCHES", 3)
    for i in range(4):
        assert store.publish(row(f"a{i}"), f"stream#{i}") and not store.publish(row("again"), "stream#0")
    for name in ("x", "y", "z", "w"):
        store.publish(row(name), name)
    assert len(store.current()["batches"]) == 3 and not store.publish(row("w"), "w") and store.has_batch("w") and not store.has_batch("other#1")
    assert store.read("sessions").count() == 8

    commit = Store._commit

    def late(self, state):
        monkeypatch.setattr(Store, "_commit", commit)
        self.publish(row("between"))
        return commit(self, state)

    monkeypatch.setattr(Store, "_commit", late)
    monkeypatch.setattr(Store, "PARTS", 1)
    assert store.tidy() == [] and store.read("sessions").count() == 9
    monkeypatch.setattr(Store, "_commit", late)
    with pytest.raises(Conflict):
        store.compact()
    assert store.compact() == ["sessions"]
    folders = {p.rpartition("/")[0] for parts in store.current()["tables"]["sessions"]["buckets"].values() for p in parts}
    monkeypatch.setattr(Store, "VERSIONS", 1)
    store.publish(row("last"))
    assert store.clean(0) == [] and len(store.clean(time.time() + 60)) >= 9 and len(folders) == 1
    assert store.read("sessions").count() == 11
