"""Repeated windows by super-k-mer partitioning; shared by the two substring dedups.

A text is a row of units (words or bytes); a window is k consecutive units. Every window has a
minimiser, the m-unit piece in it with the least hash (the leftmost of equals), so equal windows have
equal minimisers. Neighbouring windows with the same minimiser form a super-k-mer (of MOST windows at
most; longer ones are cut): one packed string that holds them all.

1. Documents are dealt into blocks by a hash. Each block sends its distinct minimisers with their
   counts, packed as one row for each bucket of hash values.
2. A bucket sums up its hashes and answers with a byte for each: seen once, repeated, or hot. A
   window whose minimiser was seen once occurs once; it needs no look at its text.
3. Blocks send the packed strings of repeated minimisers to buckets, each distinct string once with
   its number and its least document. Super-k-mers of a hot minimiser are unpacked into single windows
   that are dealt by their own content, so no bucket gets a large share of the corpus.
4. A bucket's kernel compares windows unit by unit (nothing is decided by a hash) and answers for
   each string which of its windows are to be removed.
5. Blocks put the answers together. The documents' exchange is made once and reused.

Steps 3 and 5 derive the super-k-mers again, which is cheaper than moving them. There are as many buckets as
blocks, and never more than the square root of the input over ROW_BYTES: so the packed rows that all blocks send to
all buckets stay below one for ROW_BYTES of input however large it is. A block is worked through in parts of
PART_BYTES. All columns travel as Arrow data, so ids and other columns come back as they were.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import even_keys, mix64, partitions, pick, read, spans, table

#: Bytes of text meant for a block, and for a part of it that is in work at once.
BLOCK_BYTES, PART_BYTES = 8 << 20, 8 << 20
#: Bytes of input for each packed row between blocks and buckets, at least.
ROW_BYTES = 1 << 12
#: Occurrences from which a minimiser counts as hot.
HOT = 2000
#: Windows in one super-k-mer at most, so that its marks fit a long.
MOST = 60
CHUNK = 1 << 16
NULL_ID = -(1 << 63)


class Words:
    """Runs of bytes outside blanks; a window of words is the words joined by one space."""

    BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
    #: Bytes up to which words are hashed together, eight bytes at a time.
    SHORT = 64

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        blank = self.BLANK[raw]
        ends = blank.copy()
        ends[:1], ends[1:] = False, ends[1:] & ~blank[:-1]
        kept = np.flatnonzero(~blank | ends)
        text, stops = raw[kept], np.flatnonzero(ends[kept])
        text[stops] = 32
        self.bounds = np.searchsorted(np.flatnonzero(ends), spans(np.array([len(t) + 1 for t in texts], np.int64)))
        self.starts = np.append(0, stops + 1)
        self.text = text.tobytes()
        self.units = self._hashes()

    def _hashes(self) -> np.ndarray:
        """A hash of each word by its bytes."""
        lengths = np.diff(self.starts) - 1
        out = lengths.astype(np.uint64)
        padded = self.text + bytes(8)
        words = np.ndarray(len(self.text) + 1, "<u8", padded, strides=(1,))
        left, at = np.flatnonzero(lengths <= self.SHORT), 0
        with np.errstate(over="ignore"):
            while len(left):
                part = words[self.starts[left] + at]
                unused = np.maximum(0, 8 - (lengths[left] - at)).astype(np.uint64) * np.uint64(8)
                part = part << unused
                out[left] = mix64(out[left] * np.uint64(0x9E3779B97F4A7C15) + part)
                at += 8
                left = left[lengths[left] > at]
        for i in np.flatnonzero(lengths > self.SHORT).tolist():
            out[i] = xxhash.xxh64_intdigest(self.cut(i, i + 1))
        return out

    def cut(self, first: int, end: int) -> bytes:
        return self.text[self.starts[first] : self.starts[end] - 1] if end > first else b""

    def keep(self, first: int, kept: np.ndarray) -> bytes:
        if kept.all():
            return self.cut(first, first + len(kept))
        edges = np.flatnonzero(np.diff(kept.view(np.int8), prepend=0, append=0)).reshape(-1, 2) + first
        return b" ".join([self.cut(a, b) for a, b in edges.tolist()])

    @staticmethod
    def windows(packed: bytes, k: int) -> list[bytes]:
        ends = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).tolist() + [len(packed)]
        starts = [0] + [e + 1 for e in ends[:-1]]
        return [packed[starts[i] : ends[i + k - 1]] for i in range(len(ends) - k + 1)]


class Bytes:
    """UTF-8 bytes."""

    TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def __init__(self, texts: list[bytes]):
        self.bounds = spans(np.array([len(t) for t in texts], np.int64))
        self.text = b"".join(texts)
        self.units = np.frombuffer(self.text, np.uint8)

    def cut(self, first: int, end: int) -> bytes:
        return self.text[first:end]

    def keep(self, first: int, kept: np.ndarray) -> bytes:
        return self.units[first : first + len(kept)][kept].tobytes()

    @staticmethod
    def windows(packed: bytes, k: int) -> list[bytes]:
        return [packed[i : i + k] for i in range(len(packed) - k + 1)]


def _rolled(units: np.ndarray, m: int) -> np.ndarray:
    """A hash of the m units from each position, by doubling."""
    base = np.uint64(0x9E3779B97F4A7C15)
    out, length, power = None, 0, base
    step, step_length, step_power = units, 1, base
    while True:
        if m & step_length:
            if out is None:
                out, length, power = step, step_length, step_power
            else:
                n = len(units) - length - step_length + 1
                out = out[:n] * step_power + step[length : length + n]
                length, power = length + step_length, power * step_power
        if 2 * step_length > m:
            return mix64(out)
        n = len(step) - step_length
        step = step[:n] * step_power + step[step_length:]
        step_length, step_power = 2 * step_length, step_power * step_power


def super_kmers(units: np.ndarray, bounds: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser) of each super-k-mer, in order of position."""
    w = k - m + 1
    if not 1 <= m <= k or w > CHUNK // 4:
        raise ValueError(f"pieces of {m} units don't fit windows of {k}")
    low = np.uint64(CHUNK - 1)
    valid_end = np.repeat(bounds[1:] - k, np.diff(bounds))
    firsts, sizes, minis = [], [], []
    step = CHUNK - w + 1
    with np.errstate(over="ignore"):
        for c in range(0, max(0, len(units) - k + 1), step):
            part = units[c : c + CHUNK + m - 1]
            part = Bytes.TABLE[part] if part.dtype == np.uint8 else part
            hashes = _rolled(part, m)
            key = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
            least, have = key, 1
            while 2 * have <= w:
                least = np.minimum(least[: len(least) - have], least[have:])
                have *= 2
            if have < w:
                n = len(key) - w + 1
                least = np.minimum(least[:n], least[w - have : w - have + n])
            least = least[:step]
            at = np.flatnonzero(np.arange(c, c + len(least)) <= valid_end[c : c + len(least)])
            if not len(at):
                continue
            mine = least[at]
            new = np.flatnonzero(np.concatenate([[True], (mine[1:] != mine[:-1]) | (at[1:] != at[:-1] + 1)]))
            firsts.append(at[new] + c)
            sizes.append(np.diff(np.append(new, len(at))))
            minis.append(hashes[(mine[new] & low).astype(np.int64)])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first, size, mini = np.concatenate(firsts), np.concatenate(sizes), np.concatenate(minis)
    cuts = -(-size // MOST)
    if (cuts > 1).any():
        step = (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * MOST
        first, size, mini = np.repeat(first, cuts) + step, np.minimum(np.repeat(size, cuts) - step, MOST), np.repeat(mini, cuts)
    return first, size, mini


def piece(k: int, most: int) -> int:
    """The length of the minimising piece for windows of k units: half of k, rounded up, at most most."""
    return max(1, min(most, (k + 1) // 2))


class Block:
    """Documents of a block, or of a part of it, with their super-k-mers. docs has doc_id and text as bytes."""

    def __init__(self, docs: pa.Table, kind: type, k: int, m: int):
        self.docs, self.k = docs, k
        self.doc_ids = docs.column("doc_id").to_pylist()
        self.units = kind([t or b"" for t in docs.column("text").to_pylist()])
        self.first, self.size, self.mini = super_kmers(self.units.units, self.units.bounds, k, m)
        self.doc = np.searchsorted(self.units.bounds, self.first, side="right") - 1

    def string(self, i: int) -> bytes:
        a = int(self.first[i])
        return self.units.cut(a, a + int(self.size[i]) + self.k - 1)

    def owner(self, i: int) -> int:
        doc = self.doc_ids[self.doc[i]]
        return NULL_ID if doc is None else doc


def in_parts(docs: pa.Table, kind: type, k: int, m: int) -> Callable[[], Iterator[Block]]:
    """A function that goes through a block's documents in a fixed order, in parts of about PART_BYTES."""
    ids, texts = docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or b""))
    before = spans(np.array([len(texts[i] or b"") for i in order], np.int64))[:-1] // PART_BYTES
    docs = docs.take(order)
    starts = np.flatnonzero(np.diff(before, prepend=-1)).tolist()
    if len(starts) < 2:
        whole = Block(docs, kind, k, m)
        return lambda: iter([whole])
    return lambda: (Block(docs.slice(a, b - a), kind, k, m) for a, b in zip(starts, [*starts[1:], len(order)], strict=True))


def _bucket(mini: np.ndarray, buckets: int) -> np.ndarray:
    return ((mini >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


SENT = "bucket long, block long, hashes binary, counts binary"
FLAGS = "block long, bucket long, flags binary"
STRINGS = "route long, block long, packed binary"
MARKS = "block long, packed binary"


@dataclass
class Strings:
    """Super-k-mer strings of a block for one bucket: item, least document, number and bytes of each."""

    item: np.ndarray
    doc_id: np.ndarray
    n: np.ndarray
    packed: list[bytes]

    def write(self) -> bytes:
        parts = [np.diff(self.item, prepend=0), np.diff(self.doc_id, prepend=0), self.n, [len(p) for p in self.packed]]
        return zstandard.compress(b"".join([np.array([len(self.n)], "<i8").tobytes(), *[np.asarray(x, "<i8").tobytes() for x in parts], *self.packed]), 3)

    @staticmethod
    def read(data: bytes) -> Strings:
        data = zstandard.decompress(data)
        n = int(np.frombuffer(data, "<i8", 1)[0])
        item, doc, number, size = (np.frombuffer(data, "<i8", n, 8 + 8 * n * i) for i in range(4))
        ends = (8 + 32 * n + np.cumsum(size)).tolist()
        return Strings(np.cumsum(item), np.cumsum(doc), number, [data[e - z : e] for e, z in zip(ends, size.tolist(), strict=True)])

    @staticmethod
    def joined(parts: list[Strings]) -> Strings:
        return Strings(*[np.concatenate([getattr(p, k) for p in parts]) for k in ("item", "doc_id", "n")], [x for p in parts for x in p.packed])


def sides(total: int, parallel: int) -> int:
    """Blocks, and buckets, for so many bytes: two for each partition or BLOCK_BYTES each, but never so many that
    their rows to each other come closer than ROW_BYTES of input."""
    return max(1, min(math.isqrt(total // ROW_BYTES), max(2 * parallel, math.ceil(total / BLOCK_BYTES))))


def repeated_windows(docs: DataFrame, kind: type, k: int, m: int, kernel: Callable, later_only: bool, result: Callable[[Block, np.ndarray], pa.Table], schema) -> DataFrame:
    """Runs the five steps over docs(doc_id, text and columns that result wants from block.docs).

    kernel(strings) gets the Strings of a bucket and yields (place, doc, marks): bit j of marks
    is set if window j goes. With later_only, documents after `doc` lose all of the string's
    windows as well. result(block, removed units) makes the output rows of a part of a block.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = sides(total, partitions(spark))
    # blocks, buckets and routes have numbers that the exchanges deal evenly; there are never more than sides() says
    keys = even_keys(spark, blocks, partitions(spark))
    number = F.broadcast(spark.createDataFrame(list(enumerate(keys.tolist())), "place long, block long"))
    # the partition is hashed too, so that rows repeated very often still go to many blocks
    place = F.expr(f"pmod(xxhash64(doc_id, text, spark_partition_id()), {blocks}L)")
    dealt = docs.withColumn("place", place).withColumn("text", F.col("text").cast("binary")).join(number, "place").drop("place").repartition(partitions(spark), "block")

    def send(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        hashes, counts = np.unique(np.concatenate([b.mini for b in in_parts(docs, kind, k, m)()]), return_counts=True)
        if not len(hashes):
            return table(SENT)
        used, at = np.unique(_bucket(hashes, blocks), return_index=True)
        packs = [[x.tobytes() for x in np.split(values, at[1:])] for values in (hashes, np.minimum(counts, HOT).astype("<u2"))]
        return table(SENT, keys[used], [key[0].as_py()] * len(used), *packs)

    def count(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        each = [np.frombuffer(h, np.uint64) for h in rows.column("hashes").to_pylist()]
        hashes, counts = np.concatenate(each), np.frombuffer(b"".join(rows.column("counts").to_pylist()), "<u2").astype(np.int64)
        order = np.argsort(hashes)
        first = np.flatnonzero(np.concatenate([[True], hashes[order[1:]] != hashes[order[:-1]]]))
        n = np.add.reduceat(counts[order], first)
        flags = np.empty(len(hashes), np.uint8)
        flags[order] = np.repeat((n > 1).astype(np.uint8) + (n >= HOT), np.diff(np.append(first, len(hashes))))
        return table(FLAGS, rows.column("block"), rows.column("bucket"), [x.tobytes() for x in np.split(flags, spans(np.array([len(e) for e in each]))[1:-1])])

    def strings(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return table(STRINGS)
        parts = in_parts(docs, kind, k, m)
        minis = [b.mini for b in parts()]
        # in the order of buckets, which is that of the hashes
        order = np.argsort(np.argsort(keys)[np.searchsorted(np.sort(keys), answers.column("bucket").to_numpy())])
        found = b"".join(answers.column("flags").take(pa.array(order)).to_pylist())
        flags = np.frombuffer(found, np.uint8)[np.unique(np.concatenate(minis), return_inverse=True)[1]]
        held: dict[bytes, list[int]] = {}
        at = 0
        for b in parts():
            for i in np.flatnonzero(flags[at : at + len(b.mini)]).tolist():
                packed, doc, hot = b.string(i), b.owner(i), flags[at + i] == 2
                for j, s in enumerate(kind.windows(packed, k) if hot else [packed]):
                    x = held.get(s)
                    if x is None:
                        route = xxhash.xxh64_intdigest(s) if hot else int(b.mini[i])
                        held[s] = [((at + i) * 64 + j) * 2 + int(hot), doc, 1, route % blocks]
                    else:
                        x[1], x[2] = min(x[1], doc), x[2] + 1
            at += len(b.mini)
        if not held:
            return table(STRINGS)
        item, doc, n, route = (np.array(v, np.int64) for v in zip(*held.values(), strict=True))
        packed, order = list(held), np.argsort(route, kind="stable")
        used, at = np.unique(route[order], return_index=True)
        groups = [Strings(item[g], doc[g], n[g], [packed[i] for i in g]).write() for g in np.split(order, at[1:])]
        return table(STRINGS, keys[used], [key[0].as_py()] * len(used), groups)

    def judge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        parts = [Strings.read(p) for p in rows.column("packed").to_pylist()]
        ends = np.cumsum([len(p.n) for p in parts])
        every = Strings.joined(parts)
        found = np.array(list(kernel(every, kind, k)), np.int64).reshape(-1, 3)
        found = found[np.argsort(found[:, 0], kind="stable")]
        out = [(block, g) for block, g in zip(rows.column("block").to_pylist(), np.split(found, np.searchsorted(found[:, 0], ends[:-1])), strict=True) if len(g)]
        return table(MARKS, [b for b, _ in out], [zstandard.compress(np.column_stack([every.item[g[:, 0]], g[:, 1:]]).astype("<i8").T.tobytes(), 3) for _, g in out])

    def finish(key: tuple[pa.Scalar, ...], docs: pa.Table, marks: pa.Table) -> pa.Table:
        parts = in_parts(docs, kind, k, m)
        packs = [np.frombuffer(zstandard.decompress(p), "<i8").reshape(3, -1) for p in marks.column("packed").to_pylist()]
        rows = np.concatenate([np.zeros((3, 0), np.int64), *packs], axis=1)
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        answers: dict[bytes, tuple[int, int]] = {}
        whole, single, at = [], [], 0
        for b in parts() if rows.size else ():
            mine = rows[:, slice(*np.searchsorted(rows[0], [at * 128, (at + len(b.mini)) * 128]))]
            for item, doc, mark in mine.T.tolist():
                i = item // 128 - at
                first = int(b.first[i]) + (item // 2) % 64
                answers[b.units.cut(first, first + k) if item % 2 else b.string(i)] = (doc, mark)
            whole.append(b.mini[mine[0] // 128 - at])
            single.append(b.mini[mine[0][mine[0] % 2 == 1] // 128 - at])
            at += len(b.mini)
        answered, split = np.unique(np.concatenate([np.zeros(0, np.uint64), *whole])), np.unique(np.concatenate([np.zeros(0, np.uint64), *single]))
        done = []
        for b in parts():
            gone = np.zeros(len(b.units.units) + 1, np.int64)
            places = np.flatnonzero(np.isin(b.mini, answered)) if answers else []
            unpacked = np.isin(b.mini[places], split).tolist() if answers else []
            for i, singly in zip(places, unpacked, strict=True):
                packed, a, doc = b.string(i), int(b.first[i]), b.owner(i)
                tries = [(j, 1, answers.get(s)) for j, s in enumerate(kind.windows(packed, k))] if singly else [(0, int(b.size[i]), answers.get(packed))]
                for at, size, answer in tries:
                    if answer is None:
                        continue
                    if later_only and doc > answer[0]:
                        gone[a + at] += 1
                        gone[a + at + size - 1 + k] -= 1
                    else:
                        for j in range(size):
                            if answer[1] >> j & 1:
                                gone[a + at + j] += 1
                                gone[a + at + j + k] -= 1
            done.append(result(b, np.cumsum(gone[:-1]) > 0))
        return pa.concat_tables(done)

    flags = dealt.groupBy("block").applyInArrow(send, SENT).groupBy("bucket").applyInArrow(count, FLAGS)
    packed = dealt.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(strings, STRINGS)
    marks = packed.groupBy("route").applyInArrow(judge, MARKS)
    return dealt.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(finish, schema)


def count_windows(strings: Strings, kind: type, k: int):
    """Kernel: sorts the windows of a bucket's strings; the windows that come more than once go.

    They are sorted by a hash of their units, and then those with equal hashes are compared by content.
    """
    units = kind(strings.packed)
    windows = np.diff(units.bounds) - k + 1
    owner = np.repeat(np.arange(len(windows)), windows)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    first = units.bounds[owner] + inner
    with np.errstate(over="ignore"):
        hashes = _rolled(units.units, k)[first]
    order = np.argsort(hashes, kind="stable")
    starts = np.flatnonzero(np.diff(hashes[order], prepend=hashes[order[:1]] - np.uint64(1)))
    sizes = np.diff(np.append(starts, len(order)))
    go = strings.n[owner] > 1
    go[order] |= np.repeat(sizes > 1, sizes)
    places = first[order].tolist()
    for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        text = [units.cut(p, p + k) for p in places[a : a + n]]
        if text.count(text[0]) < n:
            # unequal windows of one hash
            for i, t in zip(order[a : a + n], text, strict=True):
                go[i] = text.count(t) > 1 or strings.n[owner[i]] > 1
    marks = np.bitwise_or.reduceat(np.where(go, np.int64(1) << inner, 0), np.cumsum(windows) - windows)
    for i in np.flatnonzero(marks):
        yield int(i), 0, int(marks[i])


WORD_ROWS, WORD_TEXTS = "doc_id long, n_words long, n_removed long, kept_sha256 string", "doc_id long, n_words long, n_removed long, text string"


def word_dedup(docs: DataFrame, result, schema, k: int = 35, m: int | None = None) -> DataFrame:
    return repeated_windows(docs, Words, k, m or piece(k, 9), count_windows, False, result, schema)


def _runs(removed: np.ndarray) -> int:
    return int(np.count_nonzero(np.diff(np.concatenate([[False], removed])) & removed)) if len(removed) else 0


def by_document(block: Block, removed: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of each document, its first unit's place and which of its units go."""
    for a, b in itertools.pairwise(block.units.bounds.tolist()):
        yield a, removed[a:b]


def word_rows(block: Block, removed: np.ndarray) -> pa.Table:
    rows = [(len(gone), int(gone.sum()), hashlib.sha256(block.units.keep(a, ~gone)).hexdigest()) for a, gone in by_document(block, removed)]
    return table(WORD_ROWS, block.doc_ids, *zip(*rows, strict=True))


def kept_words(block: Block, removed: np.ndarray) -> pa.Table:
    rows = [(len(gone), int(gone.sum()), block.units.keep(a, ~gone).decode("utf-8", "replace")) for a, gone in by_document(block, removed)]
    return table(WORD_TEXTS, block.doc_ids, *zip(*rows, strict=True))


def substring_dedup(docs: DataFrame, k: int = 35, m: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, text (what is left, joined by one space), for each row.

    Removes every word that a window of k words covers whose words also start anywhere else. Null
    and blank texts have no words; texts under k words keep all. Equal rows repeat each other. Null ids
    are kept as such, and ids of any size stay exact. m is the length of minimising pieces, 9 or half of k if
    that is less; an m outside 1 to k raises. An empty table gives no row.
    """
    return word_dedup(pick(docs, doc_id=id_col, text=text_col), kept_words, WORD_TEXTS, k, m)


def without_repeats(docs: DataFrame, k: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without their repeated words; rows that lose no word stay as they were, and
    rows that lose all their words go. Other columns of any type stay; n_chars, if there, is counted anew.

    All copies of a repeated window go, the first one too, as the operator has it: a document that is
    nothing but passages which others hold as well is dropped whole."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = pick(docs, doc_id=id_col, text=text_col, **{f"other_{i}": c for i, c in enumerate(others)})

    def result(block: Block, removed: np.ndarray) -> pa.Table:
        stays, texts = [], []
        for i, ((a, gone), text) in enumerate(zip(by_document(block, removed), block.docs.column("text").to_pylist(), strict=True)):
            if not gone.any():
                stays.append(i)
                texts.append(text)
            elif not gone.all():
                stays.append(i)
                texts.append(block.units.keep(a, ~gone))
        left = block.docs.take(pa.array(stays, pa.int64()))
        texts = pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts], pa.string())
        return left.set_column(left.schema.get_field_index("text"), "text", texts).select(names)

    names = rows.columns
    left = word_dedup(rows, result, rows.schema, k)
    back = {"doc_id": id_col, "text": text_col} | {f"other_{i}": c for i, c in enumerate(others)}
    out = left.select(*[F.col(name).alias(back[name]) for name in names]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.length(F.col(f"`{text_col}`")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in others else out


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return word_dedup(pick(read(spark, sf_dir, "documents"), doc_id="doc_id", text="text"), word_rows, WORD_ROWS)


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35
), win AS (SELECT doc_id, i, array_to_string(words[i : i + 34], ' ') AS s FROM starts
), dup AS (SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)
), gone AS (SELECT DISTINCT doc_id, i + j AS p FROM dup, range(0, 35) t(j)
), lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(len(ps), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN words ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
"""
