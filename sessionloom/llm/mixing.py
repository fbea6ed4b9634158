"""Mixing sources to target weights with soft membership.

A classifier learned from the labelled table gives each document its posterior over domains. The
rates r >= 0 of the documents are fitted so that the expected tokens of each domain, the sum of r * tokens *
posterior, meet the targets: least squares, each domain in units of its target, by projected gradient steps from r = 1. Where it
brings the residual down at once, the residual is whitened by the domains' Gram matrix, so that one step would do without
the bound; else the best of several shorter and plainer steps is taken, the gradient's own among them, so no step raises the
residual. A target that no rates of 0 and more can meet so ends at the least-squares compromise. The
residual has one number for each domain; a document's rate after any number of steps follows from its
posterior and the residuals so far, so no vector of rates is kept, and each step is one
aggregate over the table of posteriors.
"""

from __future__ import annotations

import warnings
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, pick, read, stored, table

DOMAINS = ("clean", "low", "toxic")
#: Shares of the mixed corpus, and its size against what the largest domain allows at rate one.
TARGETS = {"clean": 0.96, "low": 0.03, "toxic": 0.01}
#: The same for a corpus that a quality filter has gone over: what is left of low is the doubt in other documents, and no target.
WITHOUT_LOW = {d: s for d, s in TARGETS.items() if d != "low"}
BUDGET = 1.05
#: Labelled ids that the classifier is fitted on, at most about twice this; word buckets; those kept.
FIT_ROWS, BUCKETS, KEPT = 20_000, 1 << 18, 400
#: Share of its target that a domain may be off, and steps after which a fit gives up and says so.
TOLERANCE, STEPS = 1e-3, 60
#: Least share of the squared residual that a step must take off to go on.
GAIN = 1e-5


def domain() -> F.Column:
    return F.when(F.col("quality") == 0, 1).when(F.col("toxic") == 1, 2).when((F.col("quality") == 1) | (F.col("toxic") == 0), 0)


def word_buckets(text: str | None) -> tuple[np.ndarray, int, float, float]:
    """Buckets of the distinct words (A-Z lower-cased, outer punctuation off), words, shares of capitals and marks."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    plain = {w.strip(b".,;:!?'\"()-").lower() for w in words}
    buckets = np.fromiter((zlib.crc32(w) % BUCKETS for w in plain), np.int64, len(plain))
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
    n = max(1, len(raw))
    return buckets, len(words), codes[65:91].sum() / n, (codes[33:48].sum() + codes[58:65].sum() + codes[91:97].sum() + codes[123:127].sum()) / n


class DomainModel:
    """Softmax regression over the words that tell the domains apart best, and two style shares."""

    def __init__(self, rows: list[tuple[np.ndarray, float, float, int]], domains: int, steps: int = 300):
        self.kept: dict[int, int] = {}
        y = np.array([r[3] for r in rows], np.int64)
        seen = np.zeros((domains, BUCKETS))
        for buckets, _, _, c in rows:
            seen[c, np.unique(buckets)] += 1
        size = np.bincount(y, minlength=domains).astype(float)
        self.bias = np.log((size + 1) / (size.sum() + domains))
        rate = (seen + 0.5) / (size[:, None] + 1.0)
        overall = (seen.sum(0) + 0.5) / (size.sum() + 1)
        parted = rate * np.log(rate / overall) + (1 - rate) * np.log((1 - rate) / (1 - overall))
        gain = (size[:, None] * parted).sum(0)
        for b in np.argsort(-gain, kind="stable")[:KEPT]:
            if gain[b] > 4:
                self.kept[int(b)] = len(self.kept)
        self.weights = np.zeros((domains, len(self.kept) + 2))
        if not len(rows):
            return
        x = np.array([self.features(*r[:3]) for r in rows])
        target = np.eye(domains)[y]
        momentum, bias_momentum = np.zeros_like(self.weights), np.zeros(domains)
        for _ in range(steps):
            error = self._soft(x) - target
            momentum = 0.9 * momentum + error.T @ x / len(x) + 1e-4 * self.weights
            bias_momentum = 0.9 * bias_momentum + error.mean(0)
            self.weights -= 0.5 * momentum
            self.bias = self.bias - 0.5 * bias_momentum

    def features(self, buckets: np.ndarray, upper: float, marks: float) -> np.ndarray:
        out = np.zeros(len(self.kept) + 2)
        for b in self.kept.keys() & set(buckets.tolist()):
            out[self.kept[b]] = 1
        out[-2:] = 5 * upper, 5 * marks
        return out

    def _soft(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights.T + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def posterior(self, texts) -> tuple[np.ndarray, np.ndarray]:
        found = [word_buckets(t) for t in texts]
        x = np.array([self.features(f[0], f[2], f[3]) for f in found]).reshape(len(found), len(self.kept) + 2)
        return self._soft(x), np.array([f[1] for f in found], np.int64)


LEARNED = "doc_id long, class int, buckets binary, upper double, marks double"


def learned(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DomainModel:
    """The model of the labelled documents, of many a share by hash of about fit_rows ids. Of rows with one id
    and class the least text counts, so repeated rows don't add to what the driver gets."""
    marked = labels.select("doc_id", domain().alias("class")).where("doc_id IS NOT NULL AND class IS NOT NULL").distinct()
    share = max(1, marked.count() // fit_rows)
    some = F.broadcast(marked.where(F.expr(f"pmod(xxhash64(doc_id, 13), {share}L) = 0")))

    def features(batches):
        for batch in batches:
            rows = [word_buckets(t) for t in batch.column(2).to_pylist()]
            yield from table(LEARNED, pa.chunked_array([batch.column(0)]), pa.chunked_array([batch.column(1)]), [r[0].astype("<i4").tobytes() for r in rows], [r[2] for r in rows], [r[3] for r in rows]).to_batches()

    rows = docs.join(some, "doc_id").groupBy("doc_id", "class").agg(F.min("text").alias("text")).mapInArrow(features, LEARNED).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r["class"]))
    return DomainModel([(np.frombuffer(bytes(r.buckets), "<i4"), r.upper, r.marks, r["class"]) for r in rows], len(DOMAINS))


def posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, n_tokens (words), and posterior, an array in the order of DOMAINS, for docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            p, n = shared.value.posterior(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "posterior"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>")


def rate(steps: list[np.ndarray]) -> F.Column:
    """A document's rate after these steps, each a price for each domain."""
    if not steps:
        return F.lit(1.0)
    prices = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in steps])
    cost = lambda s: F.aggregate(F.zip_with("posterior", s, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    return F.aggregate(prices, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - cost(s)))


def sure_rates(steps: list[np.ndarray]) -> list[float]:
    """The rate that a document surely of each domain has after these steps."""
    rates = np.ones(len(DOMAINS))
    for s in steps:
        rates = np.maximum(0.0, rates - s)
    return rates.tolist()


@dataclass
class Fit:
    """The steps taken, and of each domain its tokens before, its target, whether it was fitted, and what the rates give."""

    steps: list[np.ndarray] = field(default_factory=list)
    had: np.ndarray = field(default_factory=lambda: np.zeros(len(DOMAINS)))
    target: np.ndarray = field(default_factory=lambda: np.zeros(len(DOMAINS)))
    fitted: np.ndarray = field(default_factory=lambda: np.zeros(len(DOMAINS), bool))
    got: np.ndarray = field(default_factory=lambda: np.zeros(len(DOMAINS)))

    @property
    def reached(self) -> bool:
        return bool((np.abs(self.got - self.target) <= TOLERANCE * self.target + 1e-9)[self.fitted].all())

    def report(self, spark) -> DataFrame:
        rows = zip(DOMAINS, *[x.tolist() for x in (self.had, self.target, self.fitted, self.got)], strict=True)
        return spark.createDataFrame(list(rows), "domain string, had double, target double, fitted boolean, got double")


def candidates(residual: np.ndarray, part: np.ndarray, scale: np.ndarray, largest: float) -> list[np.ndarray]:
    """Prices to choose from: the gradient by multiples of its safe length, damped and shortened whitened ones."""
    gradient, inner = scale**2 * residual, scale[:, None] * part * scale
    out = [gradient * (m / largest) for m in (1, 10, 100, 1000)]
    size = np.trace(inner) + 1e-12
    out += [scale * np.linalg.solve(inner + damp * size * np.eye(len(scale)), scale * residual) for damp in (1e-4, 1e-3, 1e-2, 1e-1)]
    return out + [whitened(residual, part) * m for m in (0.1, 0.25, 0.5, 1)]


def whitened(residual: np.ndarray, part: np.ndarray) -> np.ndarray:
    return np.linalg.inv(part + np.diag(1e-6 * np.diag(part) + 1e-9)) @ residual


def fitted(table: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET, steps: int = STEPS) -> Fit:
    """The steps whose rates bring the domains' expected tokens to the targets.

    Domains without a target aren't fitted, whatever they hold. The size of the mix is such that the domain with the largest
    share has budget times the tokens it had. The squared residual, each domain in units of its target, falls with each
    step. Where the targets can't be met by rates of 0 and more, the fit ends when it falls no more, at the totals of least
    squares, and a warning tells how far off they are.
    """
    k = len(DOMAINS)
    weight = [F.col("n_tokens") * F.col("posterior")[i] for i in range(k)]

    def sums(columns: list[F.Column]) -> np.ndarray:
        return np.array([v or 0.0 for v in table.agg(*[c.alias(f"s{i}") for i, c in enumerate(columns)]).first()])

    def totals(taken: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        r = rate(taken)
        found = sums([F.sum(r * w) for w in weight] + [F.sum(F.when(r > 0, weight[i] * F.col("posterior")[j])) for i in range(k) for j in range(k)])
        return found[:k], found[k:].reshape(k, k)

    had, gram = totals([])
    share = np.array([targets.get(d, 0.0) for d in DOMAINS]) / sum(targets.values())
    if had.sum() <= 0:
        return Fit()
    fit = Fit([], had, share * budget * had[int(share.argmax())] / share.max(), share > 0, had)
    at = np.flatnonzero(fit.fitted)
    scale = 1 / np.maximum(fit.target[at], 1e-9)
    largest = max(float(np.linalg.eigvalsh(scale[:, None] * gram[np.ix_(at, at)] * scale).max()), 1e-12)

    def priced(prices: np.ndarray) -> np.ndarray:
        out = np.zeros(k)
        out[at] = prices
        return out

    def off(got: np.ndarray) -> float:
        return float((((got - fit.target)[at] * scale) ** 2).sum())

    for _ in range(steps):
        if fit.reached:
            break
        residual, part = (fit.got - fit.target)[at], gram[np.ix_(at, at)]
        taken = [*fit.steps, priced(whitened(residual, part))]
        found = totals(taken)
        if off(found[0]) > off(fit.got) / 2:
            # one aggregate tries all candidates
            tries = [[*fit.steps, priced(c)] for c in candidates(residual, part, scale, largest)]
            each = sums([F.sum(rate(t) * w) for t in tries for w in weight]).reshape(-1, k)
            best = min(range(len(tries)), key=lambda i: off(each[i]))
            if off(each[best]) > off(fit.got) * (1 - GAIN):
                break
            taken, found = tries[best], totals(tries[best])
        fit.steps, (fit.got, gram) = taken, found
    if not fit.reached:
        warnings.warn(f"after {len(fit.steps)} steps the domains {DOMAINS} have {fit.got.round(1).tolist()} tokens against targets of {fit.target.round(1).tolist()}", stacklevel=2)
    return fit


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, posterior, rate, copies and home_rate for each row.

    copies is the rate rounded down or up by the id's hash, so its mean is the rate. home_rate is the
    rate that a document surely of this one's likeliest domain (of equals, the first) has. Null and
    empty texts have no tokens and the posterior of a text without words. A null label gives no
    evidence; without labels all posteriors are alike. An empty table gives no rows.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    table = stored(posteriors(rows, learned(rows, labels)), "posteriors")
    steps = fitted(table, targets, budget).steps
    home = F.array_position("posterior", F.array_max("posterior")).cast("int")
    found = table.withColumn("rate", rate(steps)).withColumn("copies", F.floor(F.col("rate") + dither()).cast("long"))
    return found.withColumn("home_rate", F.get(F.array(*[F.lit(r) for r in sure_rates(steps)]), home - 1))


def dither() -> F.Column:
    return F.expr("pmod(xxhash64(doc_id, 17), 1048576) / 1048576D")


def sampled(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET, whole_domains: bool = True) -> DataFrame:
    """The rows of docs that the mix takes, all columns as they were; no row more than once.

    A row stays if its rate, rounded by its id's hash, is one or more. With whole_domains, rows of a domain that is taken
    whole stay as well: the doubt in a document's posterior lowers its rate, but doesn't cost the document where its
    likeliest domain has a rate of one or more. As no row is taken twice and doubtful rows stay, the domains' totals
    come near the targets only; `expected` tells them. Rows with a null id are kept. Rows that share an id go together
    where all of them would go; if the mix takes one of them, all stay. Columns may
    have any name.
    """
    goes = F.expr("copies = 0" + (" AND home_rate < 1" if whole_domains else ""))
    left = fresh_name(docs)
    out = mixed(docs, labels, targets, budget).groupBy(F.col("doc_id").alias(left)).agg(F.bool_and(goes).alias("goes")).where("goes")
    return docs.join(out.select(left), F.col("doc_id") == F.col(left), "left_anti")


def expected(docs: DataFrame, model: DomainModel) -> DataFrame:
    """domain, tokens: the expected tokens of each domain in docs, each row once."""
    found = posteriors(pick(docs, doc_id="doc_id", text="text"), model)
    sums = found.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.col("posterior")[i]), F.lit(0.0)).alias(d) for i, d in enumerate(DOMAINS)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(d).alias("domain"), F.col(d).alias("tokens")) for d in DOMAINS])))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    found = mixed(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_tokens", *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", "copies")
