"""Parsing fingerprints against a plain version, symbol by symbol, and edited texts in order."""

import hashlib

import numpy as np
import pytest

from sessionloom.llm import parsing

from ..conftest import DATA
from .test_operators import docs  # noqa: F401

M = (1 << 64) - 1
BIG = (1 << 53) + 1


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def tossed(x):
    """Small labels, unlike their neighbours', by four rounds of deterministic coin tossing."""
    label = list(x)
    for _ in range(4):
        before = [~label[0] & M, *label[:-1]]
        bits = [((a ^ b) & -(a ^ b)).bit_length() - 1 for a, b in zip(label, before, strict=True)]
        label = [2 * b + (a >> b & 1) for a, b in zip(label, bits, strict=True)]
    return label


def phrases(text):
    """The names that make a text's fingerprint."""
    x, names = [mix(ord(c) + 1) for c in text], []
    for level in range(1, parsing.ROUNDS + 1):
        if not x:
            break
        runs = []
        for s in x:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        x = [mix(s + n * 0x9E3779B97F4A7C15 & M) if n > 1 else s for s, n in runs]
        label = tossed(x)
        cuts = [0] + [i for i in range(2, len(x) - 1) if label[i] > label[i - 1] and label[i] > label[i + 1]]
        salt, new = 2 * level + 1, []
        for a, b in zip(cuts, [*cuts[1:], len(x)], strict=True):
            new.append(mix(sum(mix(s + salt & M) * (mix(2 * i + salt) | 1) for i, s in enumerate(x[a:b])) & M))
        if len(new) == 1:
            return names + new
        names += new if level >= parsing.FROM_ROUND else []
        x = new
    return names


def sketch(text):
    names, slots = phrases(text), [None] * parsing.SLOTS
    for n in names:
        s = n % parsing.SLOTS
        slots[s] = n if slots[s] is None else min(slots[s], n)
    if not names:
        return bytes(parsing.SLOTS)
    out = []
    for s in range(parsing.SLOTS):
        far = next(k for k in range(parsing.SLOTS) if slots[(s + k) % parsing.SLOTS] is not None)
        out.append(mix(slots[(s + far) % parsing.SLOTS] + far & M) >> 56)
    return bytes(out)


def likeness(a, b):
    return min(1, max(0, (sum(x == y for x, y in zip(a, b, strict=True)) / len(a) - 1 / 256) / (1 - 1 / 256)))


def test_sketches_are_those_of_the_plain_version():
    rng = np.random.default_rng(3)
    texts = ["", "x", "ab", "aaaa", "same text", "日本語 é" * 9, "a" * 300, *["".join(map(chr, rng.integers(97, 97 + k, n))) for k, n in ((1, 40), (2, 200), (3, 900), (26, 3000), (4, 17))]]
    assert [r.tobytes() for r in parsing.sketches(texts)] == [sketch(t) for t in texts]


def test_query_against_the_plain_version(spark, docs):  # noqa: F811
    got = parsing.op10_parsing(spark, DATA).toPandas().sort_values("doc_id", ascending=False)
    texts = docs.text.tolist()[::-1]
    prints = [r.tobytes() for r in parsing.sketches(texts)]
    whole = [i for i, t in enumerate(texts) if len(t) < 4000]
    assert all(prints[i] == sketch(texts[i]) for i in whole[:60])
    for i, row in enumerate(got.itertuples()):
        new = parsing.edited(texts[i], texts[(i + 1) % len(texts)])
        print_ = parsing.sketches([new])[0].tobytes()
        assert row.edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and row.n_chars == len(texts[i])
        assert row.fingerprint == prints[i].hex() and row.edited_fingerprint == print_.hex()
        assert abs(row.near_edited - likeness(prints[i], print_)) < 1e-12 and abs(row.near_next - likeness(prints[i], prints[(i + 1) % len(texts)])) < 1e-12
    assert (got.near_edited > got.near_next).mean() > 0.9


@pytest.mark.parametrize("chars", [1 << 19, 10])
def test_odd_rows_in_order(spark, monkeypatch, chars):
    monkeypatch.setattr(parsing, "BATCH_CHARS", chars)
    rows = [(BIG, "abcd" * 30, 1), (BIG + 1, None, 2), (BIG + 2, "", 3), (None, "null id", 4), (None, None, 5), (4, "one text", 6), (4, "one text", 7), (4, "another", 8), (-7, "word " * 30_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, range int").withColumn("next", parsing.F.lit(0)).withColumn("head", parsing.F.lit(1)).repartition(3)
    order = sorted(((d, t or "") for d, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for i, (d, t) in enumerate(order):
        new = parsing.edited(t, order[(i + 1) % len(order)][1])
        a, b, c = parsing.sketches([t, new, order[(i + 1) % len(order)][1]])
        want.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), round(likeness(a, b), 9), round(likeness(a, c), 9)))
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in parsing.edit_likeness(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_few_rows(spark):
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    row = parsing.edit_likeness(one).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and row.near_next == 1
    assert parsing.edit_likeness(one.where("false")).count() == 0
    assert parsing.edit_likeness(one.selectExpr("cast(null AS long) AS doc_id", "text")).count() == 1


def test_shared_passages_are_found_at_any_offset():
    middle = "".join(map(chr, np.random.default_rng(4).integers(97, 123, 4000)))
    a, b, c = parsing.sketches([middle, "zzz" + middle, middle[:2000]])
    assert parsing.likeness(a[None], b[None])[0] > 0.9 and 0.3 < parsing.likeness(a[None], c[None])[0] < 0.7
