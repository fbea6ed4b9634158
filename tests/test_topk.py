"""The best sessions by bounds against scoring all, what is read for them, and the steps that bounds are made of."""

import random

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import search, topk
from sessionloom.operators.tables import Store
from sessionloom.plans.ingest import delete_sessions, find

from .test_changes import SESSIONS, add

WORDS = ["common"] * 6 + ["often"] * 3 + ["rare", "seldom"]


def corpus(spark, rng, ids, longest=60):
    rows = []
    for i in ids:
        words = rng.choices(WORDS, k=rng.choice([0, 1, 2, rng.randint(3, longest)])) + [f"w{rng.randint(0, 999)}" for _ in range(rng.randint(0, longest))]
        rows.append((f"s{i:04d}", rng.choice("ab"), "d", None, "2026-02-01", "2026-01-01", 1, 0, 0, None, "main", " ".join(words)))
    return spark.createDataFrame(rows, SESSIONS).withColumn("started_ts", F.col("started_at").cast("timestamp"))


def found(df):
    return [(r.session_uuid, round(r["rank"], 9)) for r in df.select("session_uuid", "rank").collect()]


def test_steps_hold_their_numbers(spark):
    numbers = [*range(1, 70), 1023, 1024, 1025, 2**40 - 1, 2**40, 3 * 2**40]
    for r in spark.createDataFrame([(n,) for n in numbers], "n long").select("n", topk.step(F.col("n")).alias("step")).collect():
        assert topk.least(r.step) <= r.n <= topk.greatest(r.step) and topk.greatest(r.step) < topk.least(r.step) * 2


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("topk"), random.Random(3)
    made = Store(spark, str(at / "s"), 2)
    add(made, corpus(spark, rng, range(300)), str(at / "w0"))
    # longer and shorter sessions than before: the mean length changes, and rows of replaced sessions stay in the table
    add(made, corpus(spark, rng, range(200, 420), 200), str(at / "w1"), True)
    delete_sessions(made, spark.createDataFrame([(f"s{i:04d}",) for i in range(0, 420, 7)], "session_uuid string"))
    return made


@pytest.mark.parametrize("query, limit, filters", [("common", 5, {}), ("rare", 20, {"project": "a"}), ("common often", 3, {}), ("common rare seldom", 10, {"project": "b"}), ("often often rare", 4, {}), ("rare", 1, {}), ("common w7", 100, {}), ("rare none", 5, {})])
def test_the_best_are_those_of_all_scores(store, monkeypatch, query, limit, filters):
    monkeypatch.setattr(topk, "FIRST", 1)
    monkeypatch.setattr(topk, "GROWTH", 2)
    sessions = store.read("sessions")
    sessions = sessions.where(F.col("project_name") == filters["project"]) if filters else sessions
    want = search.ranked(store.read("postings"), store.read("doc_stats"), query).join(sessions, "session_uuid").select("session_uuid", F.round("rank", 9).alias("rank"))
    want = [(r.session_uuid, r["rank"]) for r in want.orderBy("rank", "session_uuid").limit(limit).collect()]
    got = found(find(store, query, limit, **filters))
    assert sorted(got, key=lambda r: (r[1], r[0])) == want and bool(got) == ("none" not in query)


def test_replaced_rows_at_the_top_do_not_take_places(spark, tmp_path):
    rng, store = random.Random(5), Store(spark, str(tmp_path / "s"), 1)
    best = corpus(spark, rng, range(12)).withColumn("user_messages", F.lit("rare rare rare"))
    add(store, best.unionByName(corpus(spark, rng, range(20, 60))), str(tmp_path / "w0"))
    add(store, best.withColumn("user_messages", F.lit("other words")), str(tmp_path / "w1"), True)
    want = search.ranked(store.read("postings"), store.read("doc_stats"), "rare").orderBy("rank", "session_uuid").limit(3)
    assert found(find(store, "rare", 3)) == found(want)
    # both ways of telling which rows count
    gone = store.read("impacts").where("term = 'rare'").join(store.read("doc_stats"), ["session_uuid", "batch"], "left_anti")
    assert gone.count() == 12
    store.compact(0)
    assert gone.count() == 12 and found(find(store, "rare", 3)) == found(want)
    assert store.read("impacts").join(store.read("doc_stats"), ["session_uuid", "batch"], "left_anti").isEmpty()


def test_most_rows_stay_unread(spark, tmp_path):
    n = 4000
    rows = spark.range(n).select(F.lit("common").alias("term"), F.format_string("s%05d", "id").alias("session_uuid"), (1 + F.when(F.col("id") % 97 == 0, 8 + F.col("id") % 50).otherwise(F.col("id") % 4)).cast("long").alias("tf"), (20 + F.col("id") % 300).alias("doc_len"))
    rows = rows.withColumn("cell", (topk.step(F.col("tf")) * topk.WIDTH + topk.step(F.col("doc_len"))).cast("int")).withColumn("batch", F.lit("b"))
    path = str(tmp_path / "impacts")
    rows.repartition(1).sortWithinPartitions("term", "cell").write.option("parquet.page.row.count.limit", "100").option("parquet.enable.dictionary", "false").parquet(path)
    stored, asked, read = spark.read.parquet(path), [], []

    def live(found):
        return found

    real = topk.scored

    def watched(rows, cells, weights, average):
        hits = real(rows, cells, weights, average)
        asked.append(sum(cells_n[c] for c in cells["common"]))
        hits.collect()
        read.append(hits._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value())
        return hits

    cells = topk.term_cells(stored)
    cells_n = {r.cell: r.n for r in cells.collect()}
    topk.scored = watched
    try:
        whole = spark.createDataFrame([("", 0, 2 * n, 2 * n * 170)], "term string, cell int, n long, tokens long")
        got = topk.best(stored, whole.unionByName(cells.withColumn("tokens", F.lit(0).cast("long"))), ["common"], 3, live)
    finally:
        topk.scored = real
    score = -(F.lit(topk.weight(n, 2 * n)) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("doc_len") / 170.0)))
    want = stored.select("session_uuid", score.alias("rank")).orderBy("rank", "session_uuid").limit(3).collect()
    assert [i for _, i in got] == [r.session_uuid for r in want]
    assert sum(asked) < n // 8 and sum(read) < n // 4
