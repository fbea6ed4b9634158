"""Document fingerprints by locally consistent parsing.

A text is a row of symbols. A round first names each run of one symbol, then reduces the symbols by
deterministic coin tossing (the lowest bit in which a symbol differs from the one before, with that bit's
value) until they are small numbers that differ from their neighbours, cuts phrases at local
maxima of these, and names each phrase by its content. The names are the next round's symbols. Where
two texts share a long enough passage, the same phrases arise inside it whatever its
offset: a name depends on a few neighbours only. A fingerprint is a fixed number of
slots, each the least of the names that fall into it; the likeness of two is the share of
slots that agree, less what chance gives.

All documents of a batch are parsed together, one vector operation for each step.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, partitions, pick, read, table

SLOTS = 128
#: Phrases of these rounds and later make the fingerprint, besides each text's last name.
FROM_ROUND, ROUNDS = 3, 16
BATCH_CHARS = 1 << 19


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Small labels, unlike their neighbours' within a document, by repeated coin tossing."""
    label = x
    one = np.uint64(1)
    for _ in range(4):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[first] = ~label[first]
        z = label ^ before
        bit = np.bitwise_count((z & (~z + one)) - one).astype(np.uint64)
        label = 2 * bit + ((label >> bit) & one)
    return label


def _names(x: np.ndarray, starts: np.ndarray, salt: int) -> np.ndarray:
    """A name for each phrase x[s:next s], from its symbols in order."""
    inner = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    power = mix64(inner.astype(np.uint64) * np.uint64(2) + np.uint64(salt)) | np.uint64(1)
    return mix64(np.add.reduceat(mix64(x + np.uint64(salt)) * power, starts))


def phrase_names(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, name) of the phrases that make the fingerprints."""
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    docs, names = [], []
    with np.errstate(over="ignore"):
        x = mix64(symbols + np.uint64(1))
        for level in range(1, ROUNDS + 1):
            if not len(x):
                break
            first = np.concatenate([[True], doc[1:] != doc[:-1]])
            run = np.flatnonzero(first | np.concatenate([[True], x[1:] != x[:-1]]))
            length = np.diff(np.append(run, len(x))).astype(np.uint64)
            x, doc = np.where(length > 1, mix64(x[run] + length * np.uint64(0x9E3779B97F4A7C15)), x[run]), doc[run]
            first = np.concatenate([[True], doc[1:] != doc[:-1]])
            label = _labels(x, first)
            left = np.concatenate([[0], label[:-1]])
            right = np.concatenate([label[1:], [0]])
            last = np.concatenate([first[1:], [True]])
            peak = (label > left) & (label > right) & ~last
            peak &= ~np.concatenate([[False], first[:-1]])
            starts = np.flatnonzero(first | peak)
            x, doc = _names(x, starts, 2 * level + 1), doc[starts]
            single = np.bincount(doc, minlength=len(texts))[doc] == 1
            take = single if level < FROM_ROUND else np.ones(len(x), bool)
            docs.append(doc[take])
            names.append(x[take])
            x, doc = x[~single], doc[~single]
    return (np.concatenate(docs), np.concatenate(names)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def sketches(texts: list[str]) -> np.ndarray:
    """A row of SLOTS bytes for each text. Empty slots take from the next filled one; an empty text is zero."""
    out = np.zeros((len(texts), SLOTS), np.uint8)
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= BATCH_CHARS):
            n += len(texts[j])
            j += 1
        out[i:j] = _sketches(texts[i:j])
        i = j
    return out


def _sketches(texts: list[str]) -> np.ndarray:
    doc, name = phrase_names(texts)
    nothing = np.iinfo(np.uint64).max
    least = np.full(len(texts) * SLOTS, nothing, np.uint64)
    cell = doc * SLOTS + (name % np.uint64(SLOTS)).astype(np.int64)
    order = np.lexsort((name, cell))
    cells, at = np.unique(cell[order], return_index=True)
    least[cells] = name[order][at]
    least = least.reshape(-1, SLOTS)
    empty, far = least == nothing, np.zeros(least.shape, np.uint64)
    hollow = empty.all(axis=1)
    for k in (1, 2, 4, 8, 16, 32, 64):  # after these steps every slot has looked round the whole circle
        least = np.where(empty, np.roll(least, -k, axis=1), least)
        far = np.where(empty, np.roll(far, -k, axis=1) + np.uint64(k), far)
        empty = least == nothing
    with np.errstate(over="ignore"):
        out = (mix64(least + far) >> np.uint64(56)).astype(np.uint8)
    out[hollow] = 0
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of slots that agree in rows of a and b, less chance; 0 to 1."""
    return np.clip(((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256), 0, 1)


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_rows(ids: list[int | None], texts: list[str]) -> pa.Table:
    """The rows of all texts but the last, which only follows the one before it."""
    changed = [edited(a, b) for a, b in itertools.pairwise(texts)]
    prints, new = sketches(texts), sketches(changed)
    shas = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
    shown = [[r.tobytes().hex() for r in p] for p in (prints[:-1], new)]
    return table(EDITS, ids[: len(changed)], [len(t) for t in texts[:-1]], shas, *shown, likeness(prints[:-1], new), likeness(prints[:-1], prints[1:]))


#: Bytes of text meant for a range of ids; sampled ids for each range.
RANGE_BYTES, SAMPLED = 32 << 20, 20
#: Ranges whose first ids are broadcast; those of more are joined by exchange.
MOST_RANGES = 1 << 20


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside its edited text and the next document by descending id (the last's is the first).

    Documents are dealt by ranges of ids of about RANGE_BYTES, whose borders come from a sample, and the first
    row of each range goes to the range before it as well: the driver sees about SAMPLED ids a range. A task streams its
    range in order and holds one batch. Null texts count as empty; null ids come last; rows of one id follow each
    other by text. A single row is its own next document. Ids of any size stay exact; an empty table gives no row.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    size = rows.agg(F.count("doc_id").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ranges = max(4 * partitions(spark), math.ceil((size.bytes or 0) / RANGE_BYTES))
    some = rows.where(F.expr(f"pmod(xxhash64(doc_id, 37), {max(1, size.n // (SAMPLED * ranges))}L) = 0 AND doc_id IS NOT NULL"))
    ids = np.sort(np.array([r.doc_id for r in some.select("doc_id").collect()], np.int64))
    cuts = np.unique(ids[np.linspace(0, len(ids) - 1, ranges + 1).astype(int)[1:-1]]) if len(ids) else ids

    @F.arrow_udf("long")
    def range_of(ids: pa.Array) -> pa.Array:
        at = len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="left")
        at[ids.is_null().to_numpy(zero_copy_only=False)] = len(cuts) + 1
        return pa.array(at.astype(np.int64))

    dealt = rows.withColumn("range", range_of("doc_id"))
    # a row of 24 bytes for each range, that is for RANGE_BYTES of text
    order = Window.orderBy("range")
    heads = rows.select("doc_id").withColumn("range", range_of("doc_id")).groupBy("range").agg(F.max("doc_id").alias("head"))
    heads = heads.select("head", F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy())).alias("to"))
    heads = F.broadcast(heads) if ranges <= MOST_RANGES else heads
    head = dealt.join(heads, F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", F.col("to").alias("range"), F.lit(1).alias("next"))
    both = dealt.select("doc_id", "text", "range", F.lit(0).alias("next")).unionByName(head)

    def stream(batches):
        place, done, ids, texts, chars = None, False, [], [], 0
        for batch in batches:
            for doc_id, text, at, following in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != place:
                    place, done, ids, texts, chars = at, False, [], [], 0
                if done:
                    continue
                ids.append(doc_id)
                texts.append(text)
                chars += len(text)
                if following or chars > BATCH_CHARS:
                    yield from edit_rows(ids, texts).to_batches() if len(texts) > 1 else ()
                    done, ids, texts, chars = bool(following), ids[-1:], texts[-1:], len(text)

    keys = ["range", "next", F.col("doc_id").isNull(), F.desc("doc_id"), "text"]
    return both.repartition(partitions(spark), "range").sortWithinPartitions(*keys).mapInArrow(stream, EDITS)


def op10_parsing(spark, sf_dir: str) -> DataFrame:
    return edit_likeness(read(spark, sf_dir, "documents"))
