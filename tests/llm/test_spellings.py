"""Spelling variants against plain comparisons of all words."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionloom.llm import spellings


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, times=5):
    forms, out = {}, []
    for w, n in words.items():
        others = sorted((-m, o) for o, m in words.items() if near(w, o))
        best = others[0] if others and -others[0][0] >= times * n else None
        forms[w] = best and best[1]
        out.append([w, forms[w], w, n, len(others), best and -best[0]])
    for row in out:
        while forms[row[2]]:
            row[2] = forms[row[2]]
    return sorted(tuple(map(str, r)) for r in out)


def made(seed, letters, count):
    rng = random.Random(seed)
    base = ["".join(rng.choices(letters, k=rng.randint(6, 11))) for _ in range(count)]
    words = {w: rng.choice([5, 9, 60, 700]) for w in base}
    for w in base:
        i, c = rng.randrange(len(w)), rng.choice(letters)
        for other in (w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[::-1]):
            words.setdefault(other, rng.choice([5, 9, 60, 700]))
    return words | {"x" * 300: 5, "x" * 299: 50, "x" * 301: 300}


@pytest.mark.parametrize("letters", ["abc", "abcdefghijklmnopqrstuvwxyzéÀÿ÷"])
@pytest.mark.parametrize("cell", [2048, 20])
def test_all_pairs(spark, monkeypatch, letters, cell):
    words = made(cell, letters, 150)
    monkeypatch.setattr(spellings, "CELL", cell)
    if cell < 100:
        monkeypatch.setattr(spellings, "LARGE", 1)
        monkeypatch.setattr(spellings, "SAMPLE", 300)
    got = spellings.spellings(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert sorted(tuple(map(str, r)) for r in got) == plain(words)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("aabé", min_size=1, max_size=7), min_size=1, max_size=60), st.integers(1, 8))
def test_trees_find_all(words, leaf):
    held, spellings.LEAF = spellings.LEAF, leaf
    try:
        words, found = sorted(words), set()
        for size in {len(w) for w in words}:
            cell = spellings.Cell([w for w in words if len(w) == size], [1] * len(words))
            for other in {len(w) for w in words} & {size - 1, size, size + 1}:
                mine = [w for w in words if len(w) == other]
                found |= {(mine[i], cell.words[j]) for p, q in cell.pairs(spellings.points(mine)) for i, j in zip(p, q)}
    finally:
        spellings.LEAF = held
    assert found == {(a, b) for a in words for b in words if a != b and near(a, b)}


def test_odd_rows(spark):
    rows = [(1, "Thistle thistle ÉCOLEécole don't", "x", 1), (2, None, None, 2), (3, "", "x", 3), (None, "thistle thistle thistles", "y", 4), (4, "THISTLE " * 40 + "thistlé " * 6, "x", 5), (4, "thistl " * 7, "x", 5), (4, "thistl " * 7, "x", 5), (5, "word" * 5000, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long")
    got = {r.word: r for r in spellings.variants(docs, every=None).collect()}
    assert set(got) == {"thistle", "thistlé", "thistl"} and got["thistle"].n == 44 and got["thistl"].n == 14
    assert (got["thistlé"].form, got["thistlé"].n_near, got["thistlé"].form_n) == ("thistle", 2, 44) and got["thistl"].form is None and got["thistl"].root == "thistl"
    assert not spellings.variants(docs.limit(0)).collect() and not spellings.variants(docs, least_n=10**6).collect()


def test_slips_are_planted(spark):
    import re
    import zlib

    rows, found = [(i, f"Planted example number{'abcdefgh'[i % 8]} é" * 3) for i in range(300)], Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                found[run] += 1
    got = spellings.occurrences(spark.createDataFrame(rows, "doc_id long, text string"), every=7).collect()
    assert {r.word: r.n for r in got} == dict(found) and len(found) > 10


def test_letter_counts_are_bounded():
    counts = spellings.letters(spellings.points(["a" * 500, "a" * 250 + "b" * 250]))
    assert counts.max() == 127 and np.abs(counts[0] - counts[1]).sum() == 127
