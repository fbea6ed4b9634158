"""What the store keeps by changes, against making it anew: dictionary, counts of terms, rollups of projects, growing buckets."""

import random

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import search, stats
from sessionloom.operators.tables import Store
from sessionloom.plans.ingest import delete_sessions, find, rebuild_index, with_changes

SESSIONS = "session_uuid string, project_name string, project_dir string, cwd string, backed_up_at string, started_at string, duration_secs long, input_tokens long, output_tokens long, ai_title string, git_branch string, user_messages string"
WORDS = "running runs café cafe sky ponies pony feed fed the of plan".split()


def some(spark, rng, ids, at):
    rows = [(f"s{i}", rng.choice(["a", "b", "c", None]), f"d{rng.randint(0, 3)}", rng.choice(["/x", None]), at, f"2026-01-{rng.randint(1, 28):02d}", rng.choice([None, 5, 7]), rng.randint(0, 9), None, None, "main", " ".join(rng.choices(WORDS, k=rng.randint(0, 9)))) for i in ids]
    return spark.createDataFrame(rows, SESSIONS)


def add(store, sessions, work, replace=False):
    fields = search.fields_of(sessions)
    tables = {"sessions": sessions, "doc_stats": search.doc_stats(fields), "postings": None}
    store.publish(with_changes(store, tables, work, replace), None, replace)


def held(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.mark.parametrize("seed", [1])
def test_what_is_kept_by_changes_is_what_is_made_anew(spark, tmp_path, seed):
    rng, store = random.Random(seed), Store(spark, str(tmp_path / "s"), 2)
    add(store, some(spark, rng, range(8), "2026-02-01"), str(tmp_path / "w0"))
    # replaced as of the same time as well, so that the latest session of a project may go without one as late
    for step, (ids, at) in enumerate([([2, 3, 9], "2026-02-02"), ([2, 3, 9], "2026-02-01")], 1):
        add(store, some(spark, rng, ids, at), str(tmp_path / f"w{step}"), True)
        check(store)
    delete_sessions(store, spark.createDataFrame([("s9",), ("s0",), (None,), ("none",)], "session_uuid string"))
    check(store)
    before = held(find(store, "run cafe"), "session_uuid", F.round("rank", 9))
    store.compact(0)
    check(store)
    rebuild_index(store)
    assert held(find(store, "run cafe"), "session_uuid", F.round("rank", 9)) == before
    assert store.read("term_counts").groupBy("term").count().where("count > 1").isEmpty()


def check(store):
    sessions = store.read("sessions")
    assert held(store.read("projects"), *stats.projects(sessions).columns) == held(stats.projects(sessions), *stats.projects(sessions).columns)
    fields = search.fields_of(sessions)
    index, lengths = search.postings(fields), search.doc_stats(fields)
    kept = store.read("term_counts").groupBy("term").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).where("n <> 0 OR tokens <> 0")
    assert held(kept, "term", "n", "tokens") == held(search.term_counts(index, lengths), "term", "n", "tokens")
    tokens = [r.token for r in store.read("terms").collect()]
    assert len(tokens) == len(set(tokens))
    for query in ("run", "the-of cafe", "pony sky"):
        want = search.ranked(index, lengths, query)
        got = search.ranked(store.read("postings"), store.read("doc_stats"), query, counts=store.read("term_counts"))
        assert held(got, "session_uuid", F.round("rank", 9)) == held(want, "session_uuid", F.round("rank", 9))


def test_known_tokens_do_not_go_through_python_again(spark, tmp_path):
    seen = str(tmp_path / "seen")

    class Counting(search.Analysis):
        def term(self, token):
            with open(seen, "a") as f:
                f.write(token + "\n")
            return super().term(token)

    text = lambda t: spark.createDataFrame([("s", "f", t)], "session_uuid string, field string, text string")
    first = search.new_terms(text("sky ponies sky"), None, Counting()).collect()
    more = search.new_terms(text("ponies ran sky"), spark.createDataFrame(first), Counting()).collect()
    assert {r.token: r.term for r in [*first, *more]} == {"sky": "sky", "ponies": "poni", "ran": "ran"}
    assert sorted(open(seen).read().split()) == ["ponies", "ran", "sky"]


def test_buckets_grow_with_a_table(spark, tmp_path):
    rewritten = []
    for n in (400, 1600):
        store = Store(spark, str(tmp_path / f"s{n}"), 2)
        rows = spark.range(n).select(F.format_string("k%05d", "id").alias("session_uuid"), F.sha2(F.col("id").cast("string"), 512).alias("v"))
        store.publish({"sessions": rows})
        before = sum(store.current()["tables"]["sessions"]["bytes"].values())
        assert store.split(8000) == ["sessions"] and store.split(10 * before) == []
        entry = store.current()["tables"]["sessions"]
        assert entry["modulus"] + entry["split"] == -(-before // 8000) and len(entry["buckets"]) > before // 16000
        assert held(store.read("sessions"), "session_uuid", "v") == held(rows, "session_uuid", "v")
        for key in ("k00007", "k00311"):
            assert [r.session_uuid for r in store.read("sessions", [key]).collect()] == [key]
        store.publish({"sessions": rows.where("session_uuid = 'k00007'").withColumn("v", F.lit("new"))}, None, True)
        after = store.current()["tables"]["sessions"]
        new = {p for parts in after["buckets"].values() for p in parts} - {p for parts in entry["buckets"].values() for p in parts}
        rewritten.append(sum(after["bytes"][p] for p in new))
        assert store.read("sessions").count() == n and store.read("sessions", ["k00007"]).first().v == "new"
        # one by one, a bucket more each time: only what is split is written anew
        paths = {p for parts in after["buckets"].values() for p in parts}
        have, size = after["modulus"] + after["split"], sum(after["bytes"].values())
        store.split(size // (have + 1) + 1)
        entry = store.current()["tables"]["sessions"]
        assert have < entry["modulus"] + entry["split"] and len(paths - {p for parts in entry["buckets"].values() for p in parts}) <= 2
        assert held(store.read("sessions"), "session_uuid") == held(rows, "session_uuid")
    assert max(rewritten) < 3 * 8000
