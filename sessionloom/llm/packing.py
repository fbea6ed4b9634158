"""Packing by minimum bin slack.

Documents are encoded once. Whole windows are cut off their front; what remains is shorter than a
window, so the corpus is summed up by at most `window - 1` counts of remaining lengths. On these
counts alone the plan is made: for each window a bitset subset-sum finds the multiset of remaining
lengths that comes closest to the capacity (here: with the largest length in it),
its counts are traced back, and the same window is repeated as often as the counts allow. Where no multiset fills
the window, one remainder is cut to fill it and its rest goes back to the counts. The
last, part-filled window is laid out in power-of-two sequences, which take no padding. Cost
and size of the plan depend on the window, not on the corpus. Tasks then number the remainders of
each length (first within a task, then by a prefix sum over tasks) and look their places up.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, read, stored
from .encoding import encoder, forget, slices

WINDOW = 4096


def best_fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The multiset of lengths with the sum closest to, and at most, capacity: [(length, times)].

    Bit s of the set says that s is a reachable sum. Lengths are taken from the longest down, with
    their counts split in powers of two, until the capacity itself is reached.
    """
    full = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left > 0 and length <= capacity:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & full
            left, k = left - k, 2 * k
        if reach >> capacity & 1:
            break
    at = reach.bit_length() - 1
    taken: Counter[int] = Counter()
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            taken[length] += k
    return sorted(taken.items(), reverse=True)


@dataclass
class Plan:
    """Where the r-th remainder of each length goes; rows of flat arrays, sorted by (node, rank).

    A node is a length, or what is left of a length after a cut. Ranks lo..lo+n-1 of a node have one
    entry: `take` ids go to sequence base + (r - lo) // each at offset + (r - lo) % each * take, and
    the rest, if any, goes on as rank r - lo + rank0 of node `then`.
    """

    sequences: int = 0
    entries: list[tuple[int, int, int, int, int, int, int, int, int]] = field(default_factory=list)
    nodes: int = 0

    def arrays(self) -> dict[str, np.ndarray]:
        rows = np.array(sorted(self.entries), dtype=np.int64).reshape(-1, 9)
        names = ("node", "lo", "n", "take", "base", "each", "offset", "then", "rank0")
        return {k: rows[:, i].copy() for i, k in enumerate(names)}


def plan_windows(lengths: dict[int, int], window: int = WINDOW) -> Plan:
    """Plan for {length: count}, lengths from 1 to window."""
    plan = Plan(nodes=window + 1)
    #: By remaining length: [node, next rank, count], first come first used.
    held: dict[int, list[list[int]]] = {}
    counts: dict[int, int] = {}

    def give(length: int, node: int, rank: int, n: int) -> None:
        held.setdefault(length, []).append([node, rank, n])
        counts[length] = counts.get(length, 0) + n

    def take(length: int, n: int):
        """Runs of equal-length remainders: (node, first rank, how many)."""
        counts[length] -= n
        if not counts[length]:
            del counts[length]
        while n:
            run = held[length][0]
            k = min(n, run[2])
            yield run[0], run[1], k
            run[1], run[2], n = run[1] + k, run[2] - k, n - k
            if not run[2]:
                held[length].pop(0)

    def place(length: int, times: int, each: int, base: int, offset: int) -> None:
        at = 0
        for node, rank, k in take(length, times * each):
            while k:  # a run may begin or end within a window's share
                m = k if each == 1 else (k // each * each if at % each == 0 and k >= each else min(k, each - at % each))
                first, shift = base + at // each, at % each
                per = 1 if each == 1 else (each if m >= each else m)
                plan.entries.append((node, rank, m, length, first, per, offset + shift * length, -1, 0))
                rank, k, at = rank + m, k - m, at + m

    def cut(length: int, times: int, part: int, base: int, offset: int) -> None:
        at = 0
        for node, rank, k in take(length, times):
            plan.entries.append((node, rank, k, part, base + at, 1, offset, plan.nodes, 0))
            give(length - part, plan.nodes, 0, k)
            plan.nodes += 1
            at += k

    for length, n in lengths.items():
        if n:
            give(length, length, 0, n)
    while counts:
        largest = max(counts)
        rest = dict(counts)
        rest[largest] -= 1
        if not rest[largest]:
            del rest[largest]
        chosen = Counter({largest: 1})
        for length, k in best_fill(rest, window - largest):
            chosen[length] += k
        fill = sum(length * k for length, k in chosen.items())
        times = min(counts[length] // k for length, k in chosen.items())
        spare = {length: n - chosen[length] * times for length, n in counts.items() if n > chosen[length] * times}
        part = window - fill
        if fill < window and not spare and times > 1:
            times -= 1
            spare = {length: k for length, k in chosen.items()}
        if fill == window or spare:
            if fill < window:
                longest = max(spare)
                times = min(times, spare[longest])
            base, offset = plan.sequences, 0
            for length, k in sorted(chosen.items(), reverse=True):
                place(length, times, k, base, offset)
                offset += length * k
            if fill < window:
                cut(longest, times, part, base, offset)
            plan.sequences += times
        else:  # the last window
            size, offset = 1 << (fill.bit_length() - 1), 0
            while counts:
                length = max(counts)
                part = min(length, size - offset)
                if part == length:
                    place(length, 1, 1, plan.sequences, offset)
                else:
                    cut(length, 1, part, plan.sequences, offset)
                offset, fill = offset + part, fill - part
                if offset == size:
                    plan.sequences, offset = plan.sequences + 1, 0
                    size = 1 << (fill.bit_length() - 1) if fill else 0
    return plan


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ENCODED = "doc_id long, doc_tokens long, part int, full_rank long, full_crc array<long>, tail int, tail_rank long, tail_ids binary"


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts count as empty: the end id alone. Rows are packed one by one, so equal rows and
    null ids each have their own pieces. An empty table gives no piece. The driver sees only
    the counts of lengths (at most `window` numbers) and the plan made from them.
    """
    spark = docs.sparkSession

    def encode(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        end, size = np.array([end_id], dtype=enc.dtype).tobytes(), enc.dtype.itemsize
        seen: Counter[int] = Counter()
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for texts in slices(batch.column(1)):
                rows = []
                for encoded in enc.encode(texts):
                    raw = encoded + end
                    n = len(raw) // size
                    whole, tail = divmod(n, window)
                    wide = np.frombuffer(raw[: whole * window * size], enc.dtype).astype("<u4")
                    crcs = [zlib.crc32(wide[k * window : (k + 1) * window]) for k in range(whole)]
                    rows.append((ids[at], n, part, seen[window], crcs, tail, seen[tail], raw[whole * window * size :]))
                    seen[window] += whole
                    if tail:
                        seen[tail] += 1
                    at += 1
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "doc_tokens", "part", "full_rank", "full_crc", "tail", "tail_rank", "tail_ids"])

    encoded = stored(pick(docs, doc_id=id_col, text=text_col).mapInArrow(encode, ENCODED), "encoded")
    tails = encoded.where("tail > 0").groupBy("part", F.col("tail").alias("length")).agg(F.count("*").alias("n"))
    wholes = encoded.groupBy("part").agg(F.sum(F.size("full_crc")).cast("long").alias("n")).where("n > 0").select("part", F.lit(window).alias("length"), "n")
    by_part = tails.unionByName(wholes)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = by_part.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast((plan_windows(counts, window).arrays(), np.dtype("<u2" if _small(tokenizer) else "<u4")))

    tail_base = based.where(F.col("length") < window).select("part", F.col("length").alias("tail"), F.col("base").alias("tail_base"))
    full_base = based.where(F.col("length") == window).select("part", F.col("base").alias("full_base"))
    placed = encoded.join(tail_base, ["part", "tail"], "left").join(full_base, "part", "left")
    columns = ["doc_id", "doc_tokens", "full_crc", "tail", "tail_ids", (F.coalesce("full_base", F.lit(0)) + F.col("full_rank")).alias("full"), (F.coalesce("tail_base", F.lit(0)) + F.col("tail_rank")).alias("rank")]

    def pieces(batches):
        forget()
        p, kind = plan.value
        first = np.searchsorted(p["node"], np.arange(p["node"].max(initial=0) + 2))

        def where(node: int, rank: int):
            i = first[node] + np.searchsorted(p["lo"][first[node] : first[node + 1]], rank, side="right") - 1
            r = rank - p["lo"][i]
            turn, slot = divmod(r, p["each"][i])
            take = p["take"][i]
            return int(take), int(p["base"][i] + turn), int(p["offset"][i] + slot * take), int(p["then"][i]), int(r + p["rank0"][i])

        for batch in batches:
            rows = []
            for doc_id, n, crcs, tail, raw, full, rank in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for k, crc in enumerate(crcs):
                    _, sequence, offset, _, _ = where(window, full + k)
                    rows.append((doc_id, k * window, window, crc, n, sequence, offset))
                at, node, ids = 0, tail, np.frombuffer(raw, kind).astype("<u4")
                while node >= 0 and at < tail:
                    take, sequence, offset, node, rank = where(node, rank)
                    rows.append((doc_id, len(crcs) * window + at, take, zlib.crc32(ids[at : at + take]), n, sequence, offset))
                    at += take
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.select(*columns).mapInArrow(pieces, PIECES)


def _small(tokenizer: str) -> bool:
    return encoder(tokenizer).dtype.itemsize == 2


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
