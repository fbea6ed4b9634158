"""Mixing: totals against a plain least-squares solution, and what the pipeline's stage takes."""

import warnings

import numpy as np
import pytest

from sessionloom.llm import common, mixing, quality

D = "/root/testdata/sf0.01"


def least_squares(weights, target):
    """Nonnegative rates by plain projected gradient from one: minimises the squared residuals of the domains, each in
    units of its target."""
    a = weights / target
    rates, step = np.ones(len(a)), 1 / np.linalg.eigvalsh(a.T @ a).max()
    for _ in range(400_000):
        residual = rates @ a - 1
        if np.abs(residual).max() < 1e-6:
            break
        rates = np.maximum(0, rates - step * a @ residual)
    return rates


def test_totals_are_those_of_least_squares(spark):
    docs, labels = common.read(spark, D, "documents"), common.read(spark, D, "labels")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got = mixing.mixed(docs, labels).toPandas()
    posterior = np.array(got.posterior.tolist())
    weights = posterior * got.n_tokens.to_numpy()[:, None]
    had = weights.sum(axis=0)
    target = np.array([0.96, 0.03, 0.01]) * 1.05 * had[0] / 0.96
    totals = got.rate.to_numpy() @ weights
    assert (np.abs(totals / target - 1) < 2e-3).all() and (got.rate >= 0).all()
    assert (np.abs(totals / (least_squares(weights, target) @ weights) - 1) < 5e-3).all()
    words = docs.toPandas().set_index("doc_id").text.map(lambda t: len(t.split()))
    assert (got.set_index("doc_id").n_tokens == words).all() and np.allclose(posterior.sum(axis=1), 1)
    model = mixing.learned(docs.select("doc_id", "text"), labels)
    again = model.posterior(docs.toPandas().set_index("doc_id").text.loc[got.doc_id])[0]
    assert np.allclose(again, posterior)
    assert abs(got.copies.mean() - got.rate.mean()) < 0.05


def test_a_target_out_of_reach_is_told(spark):
    rows = [(i, 10, [1.0, 0.0, 0.0] if i % 2 else [0.5, 0.25, 0.25]) for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="against targets"):
        fit = mixing.fitted(table, {"clean": 0.1, "low": 0.8, "toxic": 0.1})
    assert not fit.reached and fit.report(spark).count() == 3
    assert mixing.fitted(table, {"clean": 0.8, "low": 0.1, "toxic": 0.1}).reached


def plain_totals(posterior, n_tokens, target):
    """Accelerated projected gradient on the rates themselves."""
    w = np.array(posterior) * np.array(n_tokens, float)[:, None]
    a, rates, step = w / target, np.ones(len(w)), 1 / np.linalg.eigvalsh((w / target).T @ (w / target)).max()
    ahead, t = rates, 1.0
    for _ in range(60_000):
        new, more = np.maximum(0, ahead - step * a @ (ahead @ a - 1)), (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, rates, t = new + (t - 1) / more * (new - rates), new, more
    return rates @ w


@pytest.mark.parametrize("low", [0.0021, 0.0019, 0.0])
def test_targets_out_of_reach_end_at_least_squares(spark, low):
    posterior = [[0.98 - low, low, 0.02] if i < 100 else [0.999 - low, low, 0.001] for i in range(200)]
    table = spark.createDataFrame([(i, 10, p) for i, p in enumerate(posterior)], "doc_id long, n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="against targets"):
        fit = mixing.fitted(table)
    want = plain_totals(posterior, [10] * 200, fit.target)
    assert not fit.reached and np.allclose(fit.got, want, rtol=0.01, atol=1e-6)


def test_domains_without_a_target_are_left_alone(spark):
    rows = [(i, 10, [0.999, 0.001, 0.0] if i % 2 else [0.4, 0.0, 0.6]) for i in range(20)]
    fit = mixing.fitted(spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>"), {"clean": 0.96, "toxic": 0.01})
    assert fit.fitted.tolist() == [True, False, True] and fit.reached and np.allclose(fit.got[[0, 2]], fit.target[[0, 2]], rtol=2e-3)


def test_the_stage_keeps_clean_documents(spark):
    docs, labels = common.read(spark, D, "documents"), common.read(spark, D, "labels")
    kept = common.stored(quality.good_documents(docs, labels), "good")
    left = mixing.sampled(kept, labels, mixing.WITHOUT_LOW)
    ids = {r.doc_id for r in left.select("doc_id").collect()}
    marks = kept.join(labels, "doc_id").where("quality = 1").select("doc_id", "toxic").toPandas()
    stays = marks.doc_id.isin(ids)
    assert stays[marks.toxic == 0].all() and stays[marks.toxic == 1].mean() < 0.3
    model = mixing.learned(kept.select("doc_id", "text"), labels)
    before, after = ({r.domain: r.tokens for r in mixing.expected(t, model).collect()} for t in (kept, left))
    assert after["clean"] > 0.97 * before["clean"] and after["toxic"] < 0.4 * before["toxic"]
    without = mixing.sampled(kept, labels, mixing.WITHOUT_LOW, whole_domains=False)
    assert without.count() <= left.count()


def test_rates_follow_the_steps(spark):
    steps = [np.array([0.5, -0.25, 2.0]), np.array([-0.75, 0.0, -0.5])]
    assert mixing.sure_rates(steps) == [1.25, 1.25, 0.5] and mixing.sure_rates([]) == [1.0] * 3
    p = spark.createDataFrame([([0.2, 0.3, 0.5],)], "posterior array<double>")
    want = max(0, max(0, 1 - (0.1 - 0.075 + 1)) - (-0.15 - 0.25))
    assert abs(p.select(mixing.rate(steps)).first()[0] - want) < 1e-12


def test_odd_rows(spark):
    labels = common.read(spark, D, "labels")
    big = (1 << 53) + 1
    rows = [(big, "a b c", "x", 1), (2, None, None, None), (3, "", "x", 2), (None, "null id", "y", 3), (4, "a b", "x", 4), (4, "a b", "x", 4), (5, "word " * 30_000, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, left_out string, copies long").withColumns({"rate": mixing.F.lit(1), "other_side": mixing.F.lit("o")})
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = sorted((str(r.doc_id), r.n_tokens) for r in mixing.mixed(df, labels).collect())
        assert got == sorted((str(d), len((t or "").split())) for d, t, *_ in rows)
        left = mixing.sampled(df, labels)
        assert left.columns == df.columns and {r.left_out for r in left.collect()} <= {"x", "y", None}
        assert mixing.mixed(df.where("false"), labels).count() == 0 and mixing.sampled(df.where("false"), labels.where("false")).count() == 0
        alike = mixing.mixed(df, labels.where("false")).collect()
    assert {tuple(np.round(r.posterior, 6)) for r in alike} == {(round(1 / 3, 6),) * 3}
    marks = spark.createDataFrame([(1, None, None), (1, 0, 1), (1, 0, 1), (2, 1, 1), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r[0] for r in marks.select(mixing.domain()).collect()] == [None, 1, 1, 2, 0, 0]
    assert mixing.learned(df.select("doc_id", "text"), marks).bias.shape == (3,)
