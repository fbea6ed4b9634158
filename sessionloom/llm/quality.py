"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins. Training goes round the features again and again, each time adding
a shallow tree over the feature's bins, fitted to the gradients and curvatures summed up by bin. Then the
pairs whose joint table explains most of what is left get tables of their own, boosted the same way. A
score is the sum of looked-up bins, so a batch is scored by a few vector additions.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, read

#: Labelled rows that a model is fitted on, at most about twice this.
FIT_ROWS = 20_000
BINS, PAIR_BINS = 32, 8
THRESHOLD = 0.3

FEATURES = ("length", "words", "word_length", "word_spread", "upper", "lower", "digit", "mark", "symbol", "wide", "blank", "lines", "line_words", "distinct", "top", "pair_distinct", "line_distinct", "ended", "packed", "run", "short", "title")
_CLASS = np.zeros((256, 7))
for _k, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", range(128, 256), b" \t\n\r\x0b\x0c")):
    for _c in _chars:
        _CLASS[_c, _k] = 1


def text_features(text: str | None) -> list[float]:
    """The numbers of FEATURES for a text; null counts as empty. Takes the whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    words = raw.split()
    w = max(1, len(words))
    lens = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    codes = np.frombuffer(raw, np.uint8)
    shares = np.bincount(codes, minlength=256) @ _CLASS / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    known, counts = np.unique(np.fromiter(map(hash, words), np.int64, len(words)), return_counts=True) if words else (np.zeros(0), np.zeros(1))
    pairs = len(set(zip(words, words[1:], strict=False)))
    change = np.flatnonzero(np.diff(codes)) if len(codes) else codes
    run = np.diff(np.concatenate([[-1], change, [len(codes) - 1]])).max() if len(codes) else 0
    ended = sum(x[-1:] in b".!?" for x in lines) / max(1, len(lines))
    return [
        np.log1p(len(text)), np.log1p(len(words)), lens.mean(), lens.std(), *shares, np.log1p(len(lines)), w / max(1, len(lines)),
        len(known) / w, counts.max() / w, pairs / max(1, w - 1), len(set(lines)) / max(1, len(lines)), ended, len(zlib.compress(raw, 1)) / n, float(run),
        float((lens <= 3).mean()), sum(map(bytes.istitle, words)) / w,
    ]


@dataclass
class Model:
    edges: list[np.ndarray]
    base: float
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        total = np.full(len(x), self.base)
        for f in range(len(self.edges)):
            total += self.tables[f, bins[:, f]]
        for table, (f, g) in zip(self.pair_tables, self.pairs, strict=True):
            total += table[bins[:, f] * PAIR_BINS // BINS, bins[:, g] * PAIR_BINS // BINS]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]) if len(x) else np.zeros((0, len(edges)), np.int64)


def _value(g, h):
    return -g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values by bin of the tree that splits the bins best, greedily, depth times."""
    out = np.full(len(g), _value(g.sum(), h.sum()))
    if depth == 0 or len(g) < 2:
        return out
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(cg, ch) + _gain(g.sum() - cg, h.sum() - ch)
    k = int(gain.argmax()) + 1
    if gain[k - 1] <= _gain(g.sum(), h.sum()) + 1e-9:
        return out
    return np.concatenate([shallow_tree(g[:k], h[:k], depth - 1), shallow_tree(g[k:], h[k:], depth - 1)])


def cross_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values by cell of the best tree that cuts one axis once and each part along the other axis."""
    best, gain = np.full(g.shape, _value(g.sum(), h.sum())), -1.0
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for k in range(1, len(a)):
            parts, total = [], 0.0
            for p in (slice(0, k), slice(k, None)):
                gs, hs = a[p].sum(0), b[p].sum(0)
                row = shallow_tree(gs, hs, 1)
                total -= 2 * (row * gs).sum() + (row * row * (hs + 1.0 / len(hs))).sum()
                parts.append(np.tile(row, (len(range(*p.indices(len(a)))), 1)))
            if total > gain:
                best, gain = np.concatenate(parts), total
                best = best.T if flip else best
    return best, gain


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, rate: float = 0.15) -> Model:
    """A model of the chance that y is 1. Without rows of both labels it gives their share alone."""
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(width)]
    share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
    model = Model(edges, float(np.log(share / (1 - share))), np.zeros((width, BINS)), [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    if not 0 < y.sum() < len(y):
        return model
    bins = binned(x, edges)
    total = np.full(len(x), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for f in range(width):
            g, h = slopes()
            step = rate * shallow_tree(np.bincount(bins[:, f], g, BINS), np.bincount(bins[:, f], h, BINS))
            model.tables[f] += step
            total += step[bins[:, f]]
    coarse = bins * PAIR_BINS // BINS
    shape, cells = (PAIR_BINS, PAIR_BINS), PAIR_BINS**2
    g, h = slopes()

    def table(f, j, v):
        return np.bincount(coarse[:, f] * PAIR_BINS + coarse[:, j], v, cells).reshape(shape)

    ranked = sorted(itertools.combinations(range(width), 2), key=lambda p: -_gain(table(*p, g), table(*p, h)).sum())
    model.pairs = ranked[:pairs]
    model.pair_tables = np.zeros((len(model.pairs), *shape))
    for _ in range(pair_rounds):
        for k, (f, j) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * np.clip(cross_tree(table(f, j, g), table(f, j, h))[0], -3, 3)
            model.pair_tables[k] += step
            total += step[coarse[:, f], coarse[:, j]]
    return model


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.expr(f"crc32(cast({doc_id} AS string)) % 5 = 0"), F.lit(False))


LEARNED = "doc_id long, quality int, x array<double>"


def learned(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fits a model on labelled rows that aren't held out; of many ids, a share by hash of about fit_rows.

    Each pair of an id and a label counts once, with the least of the id's texts, so what is broadcast and what the driver
    gets are bounded by fit_rows whatever is repeated. Only the texts of the chosen ids are looked at.
    """

    def features(batches):
        for batch in batches:
            x = [text_features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    share = max(1, marked.count() // fit_rows)
    some = F.broadcast(marked.where(F.expr(f"pmod(xxhash64(doc_id, 11), {share}L) = 0")))
    rows = docs.join(some, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).mapInArrow(features, LEARNED).collect()
    rows = sorted((r.doc_id, r.quality, r.x) for r in rows)
    x = np.array([r[2] for r in rows], np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r[1] for r in rows], np.float64))


def scorer(spark, model: Model):
    """The model as a column function of the text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([text_features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
        return pd.Series(shared.value.score(x))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    Null texts count as empty and get a score like any other. Rows with a null id are scored but never
    learned from, and aren't held out. Repeated labels count once. With no usable label, or
    one kind only, every score is the share of label 1 (0.5 if there is none).
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    score = scorer(docs.sparkSession, learned(rows, labels, fit_rows))
    found = rows.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they were, with a score of at least threshold."""
    model = learned(pick(docs, doc_id="doc_id", text=text_col), labels)
    return docs.where(scorer(docs.sparkSession, model)(F.col(f"`{text_col}`")) >= threshold)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
