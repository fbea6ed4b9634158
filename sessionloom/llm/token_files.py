"""Token-ID output: fixed-width bit packing with block offsets.

A file holds consecutive documents. Every id takes the least number of bits that the vocabulary
needs; ids are packed in blocks of `BLOCK` ids that start on a byte border, so any block
can be found from the offset table and unpacked with numpy alone.

Layout (little-endian): magic, version, bits, block size, documents, ids, then the document ids, the
start of each document (and the end of the last) in ids, the byte offsets of the blocks (and
the end of the last), then the blocks. A null doc_id is marked in a bitmap after the starts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, pick, read, scratch, spans
from .encoding import encoder, slices

MAGIC = b"TOKBITS1"
BLOCK = 1 << 14
#: Ids in a file; a longer document makes a longer file.
FILE_IDS = 1 << 22
PLAIN = {8: "<u1", 16: "<u2", 32: "<u4"}


def width(vocabulary: int) -> int:
    """Bits that the largest id of a vocabulary needs."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in PLAIN:
        return ids.astype(PLAIN[bits]).tobytes()
    rows = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(rows.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(packed: bytes, bits: int, n: int) -> np.ndarray:
    if bits in PLAIN:
        return np.frombuffer(packed, PLAIN[bits], n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little", count=n * bits)
    return flat.reshape(n, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def to_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    head = np.array([bits, BLOCK, len(doc_ids), len(ids)], dtype="<u8").tobytes()
    names = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()
    absent = np.packbits(np.array([d is None for d in doc_ids], dtype=np.uint8)).tobytes()
    offsets = spans(np.array([len(b) for b in blocks], dtype=np.int64))
    return b"".join([MAGIC, head, names, spans(lengths).astype("<u8").tobytes(), absent, offsets.astype("<u8").tobytes(), *blocks])


class TokenFile:
    """Reads a file's bytes; ids(i, j) unpacks only the blocks that it needs."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.data = data
        self.bits, self.block, docs, self.n = (int(x) for x in np.frombuffer(data, "<u8", 4, 8))
        at = 40
        names = np.frombuffer(data, "<i8", docs, at)
        at += 8 * docs
        self.starts = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        size = (docs + 7) // 8
        absent = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=docs)
        at += size
        self.doc_ids = [None if a else int(d) for d, a in zip(names, absent, strict=True)]
        blocks = -(-self.n // self.block)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.body = at + 8 * (blocks + 1)

    def ids(self, first: int, end: int) -> np.ndarray:
        if end <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (end - 1) // self.block + 1
        parts = []
        for k in range(a, b):
            raw = self.data[self.body + self.offsets[k] : self.body + self.offsets[k + 1]]
            parts.append(unpack(raw, self.bits, min(self.block, self.n - k * self.block)))
        return np.concatenate(parts)[first - a * self.block : end - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def _publish(path: str, name: str, data: bytes, attempt: int) -> None:
    """Write under a name of this attempt, then move: a repeated task leaves one whole file."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    part = f"{root}/_{name}.{attempt}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{root}/{name}")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write all documents in ascending id order; returns the manifest of files.

    Null texts count as empty (the end id alone is written); a null id sorts first. Rows that
    share an id stay together, by text. An empty table writes no file. The range exchange
    deals documents evenly whatever their source; a task streams its range and holds one file.
    """
    spark = docs.sparkSession
    store_path = path

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        enc = encoder(tokenizer)
        bits = width(enc.tokenizer.get_vocab_size(with_added_tokens=True))
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        store, root = fs.FileSystem.from_uri(store_path)
        store.create_dir(root, recursive=True)
        names: list[int | None] = []
        texts: list[bytes] = []
        held = files = 0

        def close():
            nonlocal names, texts, held, files
            ids = np.frombuffer(b"".join(texts), enc.dtype)
            lengths = np.array([len(t) // enc.dtype.itemsize for t in texts], dtype=np.int64)
            name = f"ids-{task.partitionId():06d}-{files:05d}.bin"
            _publish(store_path, name, to_file(names, lengths, ids, bits), task.taskAttemptId())
            row = (name, len(names), len(ids))
            names, texts, held, files = [], [], 0, files + 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["file", "documents", "ids"])

        for batch in batches:
            ids_in = batch.column(0).to_pylist()
            at = 0
            for part in slices(batch.column(1)):
                for encoded in enc.encode(part):
                    names.append(ids_in[at])
                    texts.append(encoded + end)
                    held += len(texts[-1]) // enc.dtype.itemsize
                    at += 1
                    if held >= FILE_IDS:
                        yield close()
        if names:
            yield close()

    rows = pick(docs, doc_id=id_col, text=text_col).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = rows.mapInArrow(write, "file string, documents long, ids long")
    manifest.write.parquet(f"{path}/_manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/_manifest")


def read_token_files(spark, path: str, manifest: DataFrame) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids_crc32, file."""

    def decode(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = TokenFile(data.as_py())
                ids = f.ids(0, f.n).astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(f.starts[:-1], f.starts[1:], strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]] * n), pa.array(f.doc_ids, pa.int64()), pa.array(f.starts[:-1]), pa.array(np.diff(f.starts)), pa.array(crc, pa.int64())], ["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    before = manifest.select("file", F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.bin").load(path).select("path", "content")
    rows = files.mapInArrow(decode, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(before, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "file")


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "token-files")
    manifest = write_token_files(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 0)
    if not manifest.head(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
    return read_token_files(spark, path, manifest)
