"""Suffix-array dedup: longest previous factors decide; later copies go and the first is kept.

Byte windows come together in buckets by their minimisers (see superkmers). A bucket has the suffix array of
its windows' starts, where suffixes are compared up to k bytes, and the array of common prefixes of neighbours. For
each suffix the previous and the next smaller position are found, smaller meaning of a document with a
smaller id. Its longest previous factor is the longer of the common prefixes with these two: no other earlier suffix
shares more. A window whose longest previous factor reaches k is a later copy.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, read, table
from .superkmers import Block, Bytes, Strings, _runs, by_document, piece, repeated_windows


def suffix_array(text: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at starts by their next k bytes, and the length of the prefix, at most k, that each
    in this order shares with the one before."""
    rows = np.lib.stride_tricks.sliding_window_view(text, k)[starts]
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{k}").ravel(), kind="stable")
    rows = rows[order]
    shared = np.zeros(len(order), np.int64)
    differ = rows[1:] != rows[:-1]
    shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), k)
    return order, shared


def longest_previous(values: np.ndarray, shared: np.ndarray, least: int = 1) -> np.ndarray:
    """The longest previous factor of each suffix, in suffix order: the longest prefix that it shares with a suffix of
    a smaller value. Lengths under least count as none.

    From each place one looks back, and forward, for the nearest smaller value. A place that isn't smaller hands on to
    the one it has found so far itself, so a search takes about the logarithm of its way in steps; the common
    prefix of two places is the least of those between.
    """
    n = len(values)

    def towards(values: np.ndarray, shared: np.ndarray) -> np.ndarray:
        at, common = np.arange(n) - 1, shared.copy()
        open_ = np.arange(1, n)
        while len(open_):
            here = at[open_]
            open_ = open_[(here >= 0) & (common[open_] >= least)]
            open_ = open_[values[at[open_]] >= values[open_]]
            here = at[open_]
            common[open_], at[open_] = np.minimum(common[open_], common[here]), at[here]
        return np.where((at >= 0) & (common >= least), common, 0)

    back = towards(values, shared)
    ahead = towards(values[::-1], np.append(0, shared[:0:-1]))[::-1] if n else back
    return np.maximum(back, ahead)


def previous_factors(strings: Strings, kind: type, k: int):
    """Kernel over the strings of a bucket; equal strings of several blocks take one place."""
    place: dict[bytes, int] = {}
    where = np.array([place.setdefault(p, len(place)) for p in strings.packed], np.int64)
    doc = np.full(len(place), np.iinfo(np.int64).max)
    np.minimum.at(doc, where, strings.doc_id)
    packed = list(place)
    windows = np.array([len(p) - k + 1 for p in packed])
    text = np.frombuffer(b"".join(packed), np.uint8)
    offsets = np.cumsum(windows + k - 1) - (windows + k - 1)
    owner = np.repeat(np.arange(len(packed)), windows)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    order, shared = suffix_array(text, offsets[owner] + inner, k)
    later = np.zeros(len(owner), bool)
    later[order] = longest_previous(doc[owner[order]], shared, k) >= k
    marks = np.bitwise_or.reduceat(np.where(later, np.int64(1) << inner, 0), np.cumsum(windows) - windows) if len(packed) else np.zeros(0, np.int64)
    # a string that nothing precedes is answered only where it may have a later copy
    held = np.bincount(where, minlength=len(place))
    for i in np.flatnonzero((marks[where] != 0) | (held[where] > 1) | (strings.n > 1)):
        yield int(i), int(doc[where[i]]), int(marks[where[i]])


BYTE_ROWS, BYTE_TEXTS = (f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}" for last in ("kept_sha256 string", "kept binary"))


def byte_rows(block: Block, removed: np.ndarray) -> pa.Table:
    rows = [(len(gone), int(gone.sum()), _runs(gone), hashlib.sha256(block.units.keep(a, ~gone)).hexdigest()) for a, gone in by_document(block, removed)]
    return table(BYTE_ROWS, block.doc_ids, *zip(*rows, strict=True))


def kept_bytes(block: Block, removed: np.ndarray) -> pa.Table:
    rows = [(len(gone), int(gone.sum()), _runs(gone), block.units.keep(a, ~gone)) for a, gone in by_document(block, removed)]
    return table(BYTE_TEXTS, block.doc_ids, *zip(*rows, strict=True))


def suffix_dedup(docs: DataFrame, k: int = 50, m: int | None = None, id_col: str = "doc_id", text_col: str = "text", result=kept_bytes, schema: str = BYTE_TEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes kept, for each row.

    Removes every byte that a k-byte string covers which also starts in a document with a smaller
    id. Null texts are empty; a null id counts as smaller than any other; rows of one id do
    not take from each other. Matches never cross documents. Ids of any size stay exact. m is the length of minimising
    pieces, 22 or half of k if that is less; an m outside 1 to k raises. An empty table gives no row.
    """
    return repeated_windows(pick(docs, doc_id=id_col, text=text_col), Bytes, k, m or piece(k, 22), previous_factors, True, result, schema)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"), result=byte_rows, schema=BYTE_ROWS)


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), win AS (
  SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(1, n - 48)) AS i FROM d WHERE n >= 50)
), least AS (SELECT s, min(doc_id) AS first_doc FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)
), hit AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM win JOIN least USING (s) WHERE doc_id > first_doc
), runs AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS b FROM hit GROUP BY doc_id, g
), marked AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs
), grouped AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a) AS g FROM marked
), merged AS (SELECT doc_id, g, min(a) AS a, max(b) AS b FROM grouped GROUP BY doc_id, g
), gaps AS (SELECT m.doc_id, coalesce(lag(b) OVER (PARTITION BY m.doc_id ORDER BY a), 0) AS from_b, a, b FROM merged m
), kept AS (
  SELECT g.doc_id, string_agg(substr(h, 2 * from_b + 1, 2 * (a - 1 - from_b)), '' ORDER BY a) AS kept_h, max(b) AS last_b,
         sum(b - a + 1) AS n_removed, count(*) AS n_spans FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE kept_h || substr(h, 2 * last_b + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""
