"""Spelling variants: words one edit apart, found by k-d trees over letter counts, and the common form that each leads to."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_TABLE, crc32_sql, lower_sql, partitions, pick, read, removed, scratch, stored, table

#: Words (the first by hash) that the upper levels of the trees are made from; so many of them part a cell at least.
SAMPLE, FEWEST = 1 << 16, 8
#: Words of a cell in the mean (more where the sample is too small for that), and of one leaf of a task's tree.
CELL, LEAF = 2048, 48
#: Cells of more than so many times the mean are dealt into chunks.
LARGE = 4
#: Searching words, and compared pairs, that are held at a time.
BATCH, PAIRS = 4096, 1 << 21
#: Letters of the counts: a-z one by one, the others (U+00C0 to U+00FF) in six lots. Joining letters only brings counts nearer.
DIMS = 32
#: Words whose counts a task holds before it sends them.
HELD = 200_000

_runs = re.compile("[A-Za-zÀ-ÿ]+").findall
_LOWER = {c: c + 32 for c in range(65, 91)}

WORDS = "word string, n long"
ROUTED = "cell long, chunk long, seeks boolean, word string, n long"
FOUND = "word string, n long, n_near long, best_n long, best string"


def occurrences(docs: DataFrame, every: int | None = 199, least_length: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the runs of letters, lower-cased in A-Z; tasks sum up their rows before they send words.

    Where every is given and divides the CRC-32 of "id:run", the run loses the code point that the checksum names: slips
    planted in all rows alike. Rows whose id is null keep their runs. What is shorter than least_length isn't counted.
    """

    def counted(batches):
        found: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = None if doc_id is None or every is None else crc32(f"{doc_id}:".encode())
                for run, n in Counter(_runs(text.as_py() or "")).items():
                    if len(run) < least_length:
                        continue
                    run = run.lower() if run.isascii() else run.translate(_LOWER)
                    if start is not None and not (h := crc32(run.encode(), start)) % every:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_length:
                            continue
                    found[run] += n
                if len(found) > HELD:
                    yield from table(WORDS, list(found), list(found.values())).to_batches()
                    found.clear()
        yield from table(WORDS, list(found), list(found.values())).to_batches()

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(counted, WORDS).groupBy("word").agg(F.sum("n").alias("n"))


def points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def letters(codes: np.ndarray) -> np.ndarray:
    """How often each word has each of DIMS letters (at most 127 times)."""
    kind = np.where(codes < 128, codes - np.uint32(97), np.uint32(26) + codes % np.uint32(DIMS - 26)).astype(np.int64)
    flat = (np.arange(len(codes))[:, None] * DIMS + kind).ravel()
    return np.minimum(np.bincount(flat, minlength=len(codes) * DIMS).reshape(len(codes), DIMS), 127).astype(np.int16)


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        yield size, np.flatnonzero(sizes == size)


class Tree:
    """A k-d tree over the letter counts of words of one length.

    A node parts its words by one letter's count, as evenly as a letter can. With tight boxes a node's box is what its words
    fill; otherwise boxes part the whole space, so that words not seen yet have a leaf too. order lists the words, leaf by leaf.
    """

    def __init__(self, counts: np.ndarray, leaf: int, tight: bool):
        self.order = np.arange(len(counts))
        self.low, self.high, self.part, self.kids, self.leaves = [], [], [], [], []
        todo = [(0, len(counts), np.zeros(DIMS, np.int16), np.full(DIMS, 127, np.int16), None)]
        while todo:
            a, b, low, high, above = todo.pop()
            mine, node = counts[self.order[a:b]], len(self.low)
            if tight and b > a:
                low, high = mine.min(axis=0), mine.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.part.append((a, b))
            self.kids.append(None)
            if above is not None:
                self.kids[above] = (*(self.kids[above] or ()), node)
            dim, cut = _cut(mine) if b - a > leaf else (-1, 0)
            if dim < 0:
                self.leaves.append(node)
                continue
            more = mine[:, dim] > cut
            self.order[a:b] = np.concatenate([self.order[a:b][~more], self.order[a:b][more]])
            middle, below, over = b - int(more.sum()), high.copy(), low.copy()
            below[dim], over[dim] = cut, cut + 1
            todo += [(middle, b, over, high, node), (a, middle, low, below, node)]

    def reached(self, counts: np.ndarray, more: int, less: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of counts) where the leaf's box has words with at most more letters above a row's counts and less below."""
        todo = [(0, np.arange(len(counts)))]
        while todo:
            node, rows = todo.pop()
            mine = counts[rows]
            near = np.maximum(self.low[node] - mine, 0).sum(axis=1) <= more
            near &= np.maximum(mine - self.high[node], 0).sum(axis=1) <= less
            rows = rows[near]
            if len(rows) and self.kids[node]:
                todo += [(kid, rows) for kid in self.kids[node]]
            elif len(rows):
                yield node, rows


def _cut(counts: np.ndarray) -> tuple[int, int]:
    """The letter and the count that part the rows most evenly; letter -1 where all rows are equal."""
    best = (0, -1, 0)
    for dim in range(DIMS):
        below = np.cumsum(np.bincount(counts[:, dim]))[:-1]
        if len(below):
            cut = int(np.argmin(np.abs(2 * below - len(counts))))
            best = max(best, (int(min(below[cut], len(counts) - below[cut])), dim, cut))
    return best[1:] if best[0] else (-1, 0)


#: By how much longer the other word is: letters that it has more, and less, after one edit.
EDITS = {-1: (0, 1), 0: (1, 1), 1: (1, 0)}


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of code points differ by exactly one replaced code point, or b has exactly one more at some place."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    size = a.shape[1]
    from_left, from_right = a != b[:, :size], a != b[:, 1:]
    first = np.where(from_left.any(axis=1), from_left.argmax(axis=1), size)
    last = np.where(from_right.any(axis=1), size - 1 - from_right[:, ::-1].argmax(axis=1), -1)
    return last < first


class Cell:
    """The words of one length that a task searches."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n, self.size = words, np.array(n, np.int64), len(words[0])
        self.codes = points(words)
        counts = letters(self.codes)
        self.tree = Tree(counts, LEAF, True)
        self.floats = counts.astype(np.float32)
        self.norms = (self.floats**2).sum(axis=1)

    def pairs(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of codes, places of words) of all pairs one edit apart. Where one edit parts words, no letter's count differs by
        more than one, so the squared distance of the counts, one product for a leaf, is as good as their L1 distance."""
        more, less = EDITS[self.size - codes.shape[1]]
        counts = letters(codes)
        floats = counts.astype(np.float32)
        norms = (floats**2).sum(axis=1)
        for leaf, rows in self.tree.reached(counts, more, less):
            a, b = self.tree.part[leaf]
            mine = self.tree.order[a:b]
            step = max(1, PAIRS // len(mine))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                square = norms[some][:, None] + self.norms[mine] - 2 * (floats[some] @ self.floats[mine].T)
                i, j = np.nonzero(square <= more + less)
                i, j = some[i], mine[j]
                wide = max(1, PAIRS // codes.shape[1])
                for k in range(0, len(i), wide):
                    p, q = i[k : k + wide], j[k : k + wide]
                    short, long = (codes[p], self.codes[q]) if more >= less else (self.codes[q], codes[p])
                    good = one_edit(short, long)
                    if good.any():
                        yield p[good], q[good]

    def nearest(self, words: list[str], n: list[int]) -> Iterator[tuple]:
        """For each of the words that has words one edit away here: how many, and the most frequent (the least of equal ones)."""
        for _, rows in by_length(words):
            count, best = Counter(), {}
            mine = [words[i] for i in rows]
            for p, q in self.pairs(points(mine)):
                count.update(p.tolist())
                for i, j in zip(p.tolist(), q.tolist(), strict=True):
                    key = (-int(self.n[j]), self.words[j])
                    if i not in best or key < best[i]:
                        best[i] = key
            for i, (m, word) in best.items():
                yield mine[i], n[rows[i]], count[i], -m, word


class Cells:
    """The upper levels: for each length a tree made from a sample, whose leaves are cells. Lengths that it lacks have one cell."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, words: int):
        share = max(FEWEST, CELL * len(sizes) // max(words, 1))
        self.trees = {size: Tree(counts[sizes == size], share, False) for size in np.unique(sizes).tolist()}

    def of(self, size: int, counts: np.ndarray, more: int, less: int) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, rows) of the cells for words of that length that can hold words within reach of the rows."""
        tree = self.trees.get(size)
        for leaf, rows in tree.reached(counts, more, less) if tree else [(0, np.arange(len(counts)))]:
            yield size << 20 | leaf, rows


def routed(words: DataFrame) -> DataFrame:
    """Each word once in the cell where it is found, and as a searching word in each cell that can hold words one edit away.

    The sample of SAMPLE words only sets where cells are parted, not what is compared. Cells that come out larger than LARGE
    times the mean are dealt into chunks by the words' hash, and searching words go to all chunks.
    """

    def sampled(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for size, rows in by_length(texts):
                found = letters(points([texts[i] for i in rows])).astype(np.uint8)
                yield from table("size long, counts binary", [size] * len(rows), [c.tobytes() for c in found]).to_batches()

    total = words.count()
    some = words.select("word").orderBy(F.xxhash64("word"), "word").limit(SAMPLE).mapInArrow(sampled, "size long, counts binary").toArrow()
    counts = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(-1, DIMS).astype(np.int16)
    cells = Cells(some.column(0).to_numpy(), counts, total)
    mean = max(CELL, total * FEWEST // SAMPLE)

    def homes(batches):
        for batch in batches:
            found, texts = Counter(), batch.column(0).to_pylist()
            for size, rows in by_length(texts):
                for cell, there in cells.of(size, letters(points([texts[i] for i in rows])), 0, 0):
                    found[cell] += len(there)
            yield from table("cell long, n long", list(found), list(found.values())).to_batches()

    sizes = words.select("word").mapInArrow(homes, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    chunks = {r.cell: -(-r.n // (LARGE * mean)) for r in sizes.where(F.col("n") > LARGE * mean).collect()}

    def route(batches):
        for batch in batches:
            texts, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for size, rows in by_length(texts):
                mine = letters(points([texts[i] for i in rows]))
                for other, more, less in ((size, 0, 0), *((size + d, *e) for d, e in EDITS.items())):
                    seeks = bool(more or less)
                    for cell, there in cells.of(other, mine, more, less):
                        at = [int(rows[i]) for i in there]
                        many = chunks.get(cell, 1)
                        for chunk in range(many if seeks else 1):
                            place = [chunk] * len(at) if seeks or many == 1 else [crc32(texts[i].encode()) % many for i in at]
                            yield from table(ROUTED, [cell] * len(at), place, [seeks] * len(at), [texts[i] for i in at], [n[i] for i in at]).to_batches()

    return words.select("word", "n").mapInArrow(route, ROUTED)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best_n, best) of words(word, n): how many words are one edit away, and the most frequent of these."""

    def search(batches):
        last, cell, held, seekers = None, None, ([], []), ([], [])

        def flush():
            if seekers[0] and held[0]:
                yield from table(FOUND, *map(list, zip(*found, strict=True))).to_batches() if (found := list(cell.nearest(*seekers))) else ()
            seekers[0].clear()
            seekers[1].clear()

        for batch in batches:
            for key, chunk, seeks, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (key, chunk) != last:
                    yield from flush()
                    last, cell, held = (key, chunk), None, ([], [])
                if not seeks:
                    held[0].append(word)
                    held[1].append(n)
                    continue
                if cell is None and held[0]:
                    cell = Cell(*held)
                seekers[0].append(word)
                seekers[1].append(n)
                if len(seekers[0]) == BATCH:
                    yield from flush()
        yield from flush()

    parts = partitions(words.sparkSession)
    found = routed(words).repartition(parts, "cell", "chunk").sortWithinPartitions("cell", "chunk", "seeks").mapInArrow(search, FOUND)
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), "best"))).alias("b")
    return own.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best).select("word", "n", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def spellings(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of words(word, n), which has each word once.

    A word's form is its most frequent neighbour (the least in code-point order of equally frequent ones), if that is at least
    times as frequent. Forms get more frequent at each step, so following them ends; each round doubles the steps that
    are followed. An empty table gives no rows.
    """
    spark = words.sparkSession
    is_form = F.col("best_n") >= times * F.col("n")
    graph = stored(near_words(words).select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    roots, path, moved = graph.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), None, True
    while moved:
        before, path = path, scratch(spark, "roots")
        step = roots.select(F.col("word").alias("k"), F.col("root").alias("then"))
        (roots if before is None else roots.join(step, F.col("root") == F.col("k"), "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved"))).write.parquet(path)
        roots = spark.read.schema("word string, root string, moved boolean").parquet(path)
        if before:
            removed(spark, before)
        moved = bool(roots.where("moved").head(1))
    ends = roots.select(F.col("word").alias("k"), "root")
    return graph.join(ends, F.col("word") == F.col("k"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, every: int | None = 199, least_length: int = 6, least_n: int = 5, times: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spelling variants of a table's words: all words of at least least_length code points and least_n occurrences.

    Whole texts count; a null or empty text has no words, equal rows count each, other columns don't matter, and an empty table
    gives no rows. See occurrences for every and null ids, spellings for the columns.
    """
    words = stored(occurrences(docs, every, least_length, id_col, text_col).where(F.col("n") >= least_n), "words")
    return spellings(words, times)


def op12_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))


OP12_SQL = f"""WITH RECURSIVE crc AS MATERIALIZED {CRC_TABLE},
runs AS MATERIALIZED (SELECT doc_id, {lower_sql("run")} AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
sums AS MATERIALIZED (SELECT run, n, {crc32_sql("(doc_id || ':' || run)")} AS h FROM runs, crc WHERE length(run) >= 6),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM sums)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
places AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words),
cuts AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS rest FROM places),
near AS MATERIALIZED (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.head = b.head AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, c.n, w.word, w.n FROM cuts c JOIN words w ON w.word = c.head || c.rest
  UNION SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON w.word = c.head || c.rest),
best AS (SELECT word, count(*) AS n_near, min({{'m': -other_n, 'w': other}}) AS b FROM near GROUP BY 1),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 5 * n THEN b.w END AS form, CASE WHEN -b.m >= 5 * n THEN -b.m END AS form_n
  FROM words LEFT JOIN best USING (word)),
paths AS (SELECT word, word AS reached, 0 AS steps FROM forms
  UNION ALL SELECT p.word, f.form, steps + 1 FROM paths p JOIN forms f ON f.word = p.reached WHERE f.form IS NOT NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(reached, steps) AS root FROM paths GROUP BY 1) USING (word)"""
