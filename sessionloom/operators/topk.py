"""The best sessions for a question of single terms, without reading the postings that can't be among them.

Each term and session has one row of impacts: how often, in a session of what length. Both numbers in steps make a cell; rows
of a term lie in the order of their cells, so that pages and row groups of cells that aren't asked for stay unread. How many
sessions a term has in each cell is kept in term_cells. The most that a session of a cell can score follows from the cell and
the corpus as it is now, so that nothing has to be made anew when the corpus grows.
"""

from __future__ import annotations

from collections import Counter
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import K1, B

#: Cells have a step of the count times this, and a step of the length.
WIDTH = 128
#: Rows that the first look at the cells takes in for each row asked for, and by how much later looks grow.
FIRST, GROWTH = 64, 8
#: Bounds are raised by this part, as sums of doubles depend on their order.
SLACK = 1e-9


def step(number: Column) -> Column:
    """Half octaves of a whole number from 1 on: two steps for each doubling."""
    bits = F.bin(number)
    return 2 * (F.length(bits) - 1) + F.coalesce(F.substring(bits, 2, 1).try_cast("int"), F.lit(0))


def least(step: int) -> int:
    return max(1, ((2 + step % 2) << (step // 2)) >> 1)


def greatest(step: int) -> int:
    return max(1, least(step + 1) - 1)


def impacts(index: DataFrame, lengths: DataFrame) -> DataFrame:
    """term, session_uuid, tf (over all fields), doc_len, cell: one row for each term of a session."""
    rows = index.groupBy("term", "session_uuid").agg(F.sum("tf").cast("long").alias("tf")).join(lengths.select("session_uuid", F.greatest("doc_len", F.lit(1)).alias("doc_len")), "session_uuid")
    return rows.select("term", "session_uuid", "tf", "doc_len", (step(F.col("tf")) * WIDTH + step(F.col("doc_len"))).cast("int").alias("cell"))


def term_cells(rows: DataFrame, sign: int = 1) -> DataFrame:
    """term, cell, n: the sessions of each term in each cell. They add up like term counts."""
    return rows.groupBy("term", "cell").agg((F.count("*") * sign).alias("n"))


def weight(n: int, size: int) -> float:
    value = log((size - n + 0.5) / (n + 0.5))
    return value if value > 0 else 1e-6


def part(weight: float, tf: int, length: int, average: float) -> float:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def bounds(cells: dict[str, dict[int, int]], weights: dict[str, float], average: float) -> dict[str, dict[int, float]]:
    """For each term and cell the most that a session of it can score with all terms.

    A session's length is the same for all its terms: the other terms count with their best cell of that length, and a length
    that one of them lacks scores nothing, as all terms must be there."""
    own = {t: {c: part(weights[t], greatest(c // WIDTH), least(c % WIDTH), average) for c in held} for t, held in cells.items()}
    tops = {t: {} for t in cells}
    for t, held in own.items():
        for c, value in held.items():
            tops[t][c % WIDTH] = max(value, tops[t].get(c % WIDTH, 0.0))
    found = {}
    for t, held in own.items():
        others = [tops[o] for o in cells if o != t]
        found[t] = {c: (value + sum(o[c % WIDTH] for o in others)) * (1 + SLACK) for c, value in held.items() if all(c % WIDTH in o for o in others)}
    return found


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scored(rows: DataFrame, asked: dict[str, dict[int, float]], weights: dict[str, float], average: float) -> DataFrame:
    """session_uuid, batch, rank of the sessions that hold all terms, from the rows of the cells asked for.

    They are asked for as a range of lengths for each step of counts, as ranges reach the pages of a scan and long lists don't;
    cells between them may come along."""
    wanted, factors = [], []
    for term, cells in asked.items():
        name = quoted(term)
        factors.append(f"WHEN {name} THEN {weights[term]!r}D")
        for s in sorted({c // WIDTH for c in cells}):
            of = [c for c in cells if c // WIDTH == s]
            wanted.append(f"(term = {name} AND cell BETWEEN {min(of)} AND {max(of)})")
    score = F.expr(f"CASE term {' '.join(factors)} END * tf * {K1 + 1!r}D / (tf + {K1!r}D * ({1 - B!r}D + {B!r}D * doc_len / {average!r}D))")
    rows = rows.where(" OR ".join(wanted))
    if len(asked) == 1:
        return rows.select("session_uuid", "batch", (-score).alias("rank"))
    found = rows.groupBy("session_uuid", "batch").agg((-F.sum(score)).alias("rank"), F.count("*").alias("n"))
    return found.where(F.col("n") == len(asked)).drop("n")


def best(rows: DataFrame, counts: DataFrame, terms: list[str], limit: int, live, passed: DataFrame | None = None) -> list[tuple[float, str]]:
    """rank and session_uuid of the best sessions that hold all terms (one named twice counts twice), in their order.

    rows are impacts with the batch that wrote them; counts are those of term_cells and, with an empty term, the corpus's sessions and tokens; passed has the sessions that filters
    let through. live takes rows of session_uuid and batch, and leaves those that count. The cells of the highest bounds are
    read first. What isn't read scores less than the lowest bound read: a session at that bound or above settles the places up to its
    own. Each further look takes in the cells at the last place's score or above, if all places are filled, else eight times as many rows.
    """
    held: dict[str, dict[int, int]] = {t: {} for t in terms}
    size = tokens = 0
    for r in counts.where(F.col("term").isin("", *held)).groupBy("term", "cell").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).where("n > 0").collect():
        if r.term:
            held[r.term][r.cell] = r.n
        else:
            size, tokens = r.n, r.tokens
    if not all(held.values()):
        return []
    average, times = tokens / size, Counter(terms)
    weights = {t: times[t] * weight(sum(of.values()), size) for t, of in held.items()}
    most = bounds(held, weights, average)
    rare = min(held, key=lambda t: (sum(held[t].values()), t))
    order = sorted(most[rare].items(), key=lambda x: -x[1])
    aim = FIRST * limit
    while order:
        seen, floor = 0, 0.0
        for cell, bound in order:
            if seen >= aim:
                break
            seen, floor = seen + held[rare][cell], bound
        floor = 0.0 if floor <= order[-1][1] else floor
        while True:
            asked = {t: {c: b for c, b in of.items() if b >= floor} for t, of in most.items()}
            if not all(asked.values()):
                # every term reaches the bound only with the rest of it
                found = []
                break
            hits = scored(rows, asked, weights, average)
            hits = hits if passed is None else hits.join(passed, "session_uuid", "left_semi")
            found = first(hits, limit, live)
            if floor == 0.0 or len(found) < limit or -found[-1][0] >= floor:
                break
            floor = -found[-1][0]
        if floor == 0.0 or len(found) == limit:
            return found
        aim *= GROWTH
    return []


def first(hits: DataFrame, limit: int, live) -> list[tuple[float, str]]:
    """The first rows that count. Twice as many are looked up by id; only if too few of these count, all are joined."""
    ordered = lambda df: df.orderBy("rank", "session_uuid").limit(2 * limit).select("rank", "session_uuid", "batch").collect()
    top = ordered(hits)
    kept = live(top)
    if len(kept) < limit and len(top) == 2 * limit:
        kept = ordered(live(hits))
    return [(r["rank"], r.session_uuid) for r in kept[:limit]]
