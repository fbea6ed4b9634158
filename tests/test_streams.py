"""Sessions that end by quiet or by their longest wait: the same rows whatever the triggers, each session once."""

import random

import pytest
from pyspark.sql import functions as F

from sessionloom.streaming import live

QUIET, WAIT, LATE = 600, 3000, 900


def events(seed):
    """(second, session): gaps around the quiet time and far over the watermark, in an order that lateness allows."""
    rng, out = random.Random(seed), []
    for s in range(12):
        t = rng.randrange(5000)
        for _ in range(rng.randrange(1, 25)):
            out.append((t, f"s{s}"))
            t += rng.choice([1, 60, 300, 599, 600, 601, 700, 4000, 20_000] if s % 3 else [100, 200, 300])
    return sorted(out, key=lambda e: e[0] + rng.randrange(400))


def wanted(rows, watermark):
    out = []
    for s in {s for _, s in rows}:
        times = sorted(t for t, x in rows if x == s)
        run = [times[0]]
        for t in times[1:]:
            if t - run[-1] > QUIET or t > times[0] + WAIT:
                break
            run.append(t)
        end = min(run[-1] + QUIET, times[0] + WAIT)
        if end < watermark:
            out.append((s, run[0], run[-1], len(run), "quiet" if run[-1] + QUIET <= times[0] + WAIT else "max_wait"))
    return sorted(out)


def run(spark, tmp_path, rows, triggers, remember=None):
    size = -(-len(rows) // triggers)
    for i in range(triggers):
        part = spark.createDataFrame([(t, s) for t, s in rows[i * size : (i + 1) * size]], "t long, session_uuid string")
        part.coalesce(1).select(F.timestamp_seconds("t").alias("ts"), "session_uuid").write.mode("append").parquet(f"{tmp_path}/in/{i:03d}")
    stream = spark.readStream.schema("ts timestamp, session_uuid string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ended = live.ended_sessions(stream, QUIET, WAIT, f"{LATE} seconds", remember)
    query = ended.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out")
    query.awaitTermination()
    got = spark.read.schema(ended.schema).parquet(f"{tmp_path}/out")
    left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return sorted((r.session_uuid, r.a, r.b, r.events, r.reason) for r in got.select("*", F.unix_seconds("started").alias("a"), F.unix_seconds("ended").alias("b")).collect()), left


@pytest.mark.parametrize("triggers", [1, 3, 20])
def test_triggers_change_nothing(spark, tmp_path, triggers):
    rows = events(7)
    got, left = run(spark, tmp_path, rows, triggers)
    want = wanted(rows, max(t for t, _ in rows) - LATE)
    assert got == want and len(want) > 8 and {r[4] for r in want} == {"quiet", "max_wait"} and len({r[0] for r in got}) == len(got)
    assert left[-1] == 12


def test_marks_go_after_a_while(spark, tmp_path):
    rows = [(1, "a"), (10, "a"), (5, None), (50_000, "b"), (200_000, "c"), (400_000, "d")]
    got, left = run(spark, tmp_path, rows, 6, remember=1000)
    assert [r[:4] for r in got] == [("a", 1, 10, 2), ("b", 50_000, 50_000, 1), ("c", 200_000, 200_000, 1)] and left[-1] <= 2


def captured(spark, tmp_path, rows, triggers, remember=None):
    size = -(-len(rows) // triggers)
    for i in range(triggers):
        part = spark.createDataFrame([(t, s) for t, s in rows[i * size : (i + 1) * size]], "t long, session_uuid string")
        part.coalesce(1).select(F.timestamp_seconds("t").alias("ts"), "session_uuid").write.parquet(f"{tmp_path}/in/{i:03d}")
        # as they come, with a stream that ends and goes on again
        stream = spark.readStream.schema("ts timestamp, session_uuid string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        live.capture_ended(stream, f"{tmp_path}/out", QUIET, WAIT, LATE, remember).awaitTermination()
    got = live.ended_rows(spark, f"{tmp_path}/out", QUIET, WAIT).select("*", F.unix_seconds("started").alias("a"), F.unix_seconds("ended").alias("b"))
    return sorted((r.session_uuid, r.a, r.b, r.events, r.reason) for r in got.collect())


@pytest.mark.parametrize("seed, triggers", [(7, 1), (7, 6), (3, 4)])
def test_captured_by_batches(spark, tmp_path, seed, triggers):
    rows = events(seed)
    want = wanted(rows, max(t for t, _ in rows) - LATE)
    assert captured(spark, tmp_path, rows, triggers) == want and len(want) > 8


def test_captured_marks_go_after_a_while(spark, tmp_path):
    rows = [(1, "a"), (10, "a"), (None, "a"), (5, None), (50_000, "b"), (60_000, "a"), (60_100, "a"), (200_000, "c"), (200_010, "a"), (199_200, "b"), (1, "late"), (400_000, "d")]
    once = [("a", 1, 10, 2, "quiet"), ("b", 50_000, 50_000, 1, "quiet"), ("c", 200_000, 200_000, 1, "quiet")]
    assert captured(spark, tmp_path / "kept", rows, 12) == once
    assert [r[:2] for r in captured(spark, tmp_path / "gone", rows, 12, remember=1000)] == [("a", 1), ("a", 60_000), ("a", 200_010), ("b", 50_000), ("b", 199_200), ("c", 200_000)]


def test_ended_sessions_stay_out_of_python(spark, monkeypatch):
    """A call of Python for each session took milliseconds, so millions of sessions hours."""
    from sessionloom.plans import registry

    monkeypatch.setattr(live, "ended_sessions", None)
    assert registry.sessions_ended(spark, "/root/testdata/sf0.001").count() > 0
