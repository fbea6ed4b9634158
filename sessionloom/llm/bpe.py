"""BPE encoding and decoding by tree concatenation: halves are encoded apart, and windows around each join again until both sides agree."""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, pick, read, table
from .encoding import Seen, WordEncoder, slices

#: Symbols of a pre-token, and code points of a text, that are encoded in one go; longer ones are halved.
PIECE, LEAF = 64, 32_768
#: Tokens on each side of a join in the first window.
WINDOW = 4
#: Words on each side of a join of texts in the first window: the one that is cut and one to agree on.
WORDS = 2

CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class TreeEncoder(WordEncoder):
    """Encodes and decodes as the tokenizers library does.

    A pre-token of more than PIECE symbols is halved down to pieces that the library's merge model encodes. Tokens next to
    each other in some encoding are next to each other in the encoding of any text made of such pairs, as long as each
    merge only joins what earlier merges (or none) made. So where a window across a join, encoded again, has a token that a half
    has at the same place, the half's tokens beyond it stay. The last token of a half or window isn't compared: it holds the
    mark of a word's end. A vocabulary whose merges are in another order is encoded by the library alone.
    """

    def __init__(self, path: str, limit: int = 700_000):
        import json

        super().__init__(path, limit)
        said = json.loads(self.tokenizer.to_str())
        added = said["added_tokens"]
        self.added = [a["content"] for a in added]
        model = said["model"]
        made: dict[str, int] = {}
        suffix = model.get("end_of_word_suffix") or ""
        in_order = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
        for at, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            in_order &= made.get(a, -1) < at and made.get(b, -1) < at and (a in made or len(a.removesuffix(suffix)) == 1) and (b in made or len(b.removesuffix(suffix)) == 1)
            made.setdefault(a + b, at)
        self.halves = in_order and not any(a["normalized"] for a in added)
        tokens = sorted(self.tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda t: t[1])
        self.token = [t for t, _ in tokens] if [i for _, i in tokens] == list(range(len(tokens))) else {i: t for t, i in tokens}
        self.size = {i: len(t.removesuffix(suffix)) if suffix else len(t) for t, i in tokens}
        self.pretokens = Seen(lambda raw: np.array(self.tree(raw), self.dtype).tobytes())
        self.plain_decode = self.tokenizer.decoder is None

    def _pretokens(self, word: str) -> list[str]:
        tok = self.tokenizer
        text = tok.normalizer.normalize_str(word) if tok.normalizer else word
        return [p for p, _ in tok.pre_tokenizer.pre_tokenize_str(text)] if tok.pre_tokenizer else [text]

    def _new(self, word: str) -> bytes:
        if len(word) <= PIECE or not self.halves or any(a in word for a in self.added):
            return super()._new(word)
        return b"".join(map(self.pretokens.__getitem__, self._pretokens(word)))

    def merged(self, raw: str) -> list[int]:
        return [t.id for t in self.model.tokenize(raw)]

    def tree(self, raw: str) -> list[int]:
        """The ids of one pre-token, level by level upwards from pieces of at most PIECE symbols."""
        pieces = 1
        while len(raw) > PIECE * pieces:
            pieces *= 2
        cuts = [len(raw) * k // pieces for k in range(pieces + 1)]
        level = [self.merged(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        while len(level) > 1:
            level = [self._join(raw[cuts[2 * k * w] : cuts[2 * (k + 1) * w]], level[2 * k], level[2 * k + 1]) for w in (pieces // len(level),) for k in range(len(level) // 2)]
        return level[0]

    def _starts(self, ids: list[int], at: int) -> list[int]:
        out = []
        for i in ids:
            out.append(at)
            at += self.size[i]
        return out

    def _join(self, raw: str, left: list[int], right: list[int]) -> list[int]:
        grow, middle = WINDOW, sum(map(self.size.__getitem__, left))
        while True:
            head, tail = left[max(0, len(left) - grow) :], right[:grow]
            begin = middle - sum(map(self.size.__getitem__, head))
            end = middle + sum(map(self.size.__getitem__, tail))
            seam = self.merged(raw[begin:end])
            places = self._starts(seam, begin)
            ours = {place: k for k, place in enumerate(zip(places[:-1], seam, strict=False))}
            before, after = [(0, 0)], [(len(seam), len(right))]
            if len(head) < len(left):
                there = zip(self._starts(head[:-1], begin), head, strict=False)
                before = [(ours[p], len(left) - len(head) + k) for k, p in enumerate(there) if p in ours]
            if len(tail) < len(right):
                there = zip(self._starts(tail[:-1], middle), tail, strict=False)
                after = [(ours[p], k) for k, p in enumerate(there) if p in ours]
            if before and after and before[0][0] <= after[-1][0]:
                (first, keep), (last, drop) = before[0], after[-1]
                return left[:keep] + seam[first:last] + right[drop:]
            grow *= 2

    def text_of(self, ids: bytes) -> str:
        """What the library decodes from these ids, special tokens included."""
        numbers = np.frombuffer(ids, self.dtype).tolist()
        if self.plain_decode:
            return " ".join(map(self.token.__getitem__, numbers))
        return self.tokenizer.decode(numbers, skip_special_tokens=False)

    def joined(self, a: tuple[str, bytes], b: tuple[str, bytes]) -> tuple[str, bytes]:
        """Text and ids of two neighbouring parts of a text, put together.

        The window starts and ends between a mark and a blank, which no pre-token crosses, or where the parts do. It grows until its
        first word and its last one have the ids that the parts give them.
        """
        words = WORDS
        while True:
            i, j = _border_before(a[0], words), _border_after(b[0], words)
            left, right = a[0][i:], b[0][:j]
            inner, outer = _border_after(left, 1), _border_before(right, 1)
            whole, first, last, seam = self.encode([left, left[:inner], right[outer:], left + right])[:4]
            of_right = self.encode([right])[0]
            agree = (i == 0 or (inner < len(left) and a[1].endswith(whole) and whole.startswith(first) and seam.startswith(first))) and (
                j == len(b[0]) or (outer > 0 and b[1].startswith(of_right) and of_right.endswith(last) and seam.endswith(last))
            )
            if agree:
                return a[0] + b[0], (b"" if i == 0 else a[1][: len(a[1]) - len(whole)]) + seam + (b"" if j == len(b[0]) else b[1][len(of_right) :])
            words *= 2


def _border_before(text: str, count: int) -> int:
    """Where the count-th last blank behind a mark lies; 0 if there are fewer."""
    at = len(text)
    while count and at > 0:
        at = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at), 0)
        count -= at > 0 and not text[at - 1].isspace()
    return at


def _border_after(text: str, count: int) -> int:
    """Where the count-th blank behind a mark lies; the text's length if there are fewer."""
    at = 0
    while count and at < len(text):
        at = min((p for p in (text.find(" ", at + 1), text.find("\n", at + 1)) if p >= 0), default=len(text))
        count -= at < len(text) and not text[at - 1].isspace()
    return at


_trees: dict[str, TreeEncoder] = {}


def tree_encoder(path: str) -> TreeEncoder:
    """One for each vocabulary and Python worker."""
    if path not in _trees:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _trees[path] = TreeEncoder(path)
    return _trees[path]


def _digest(enc: TreeEncoder, ids: bytes) -> tuple[int, str, str]:
    numbers = np.frombuffer(ids, enc.dtype).astype("<u4")
    return len(numbers), hashlib.sha256(numbers).hexdigest(), hashlib.sha256(enc.text_of(ids).encode()).hexdigest()


def coded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every document.

    Texts of at most leaf code points are encoded where they lie. Longer ones are cut into leaves that
    all tasks encode; a document's leaves are then joined two by two in the task of the document, which holds its text and ids.
    Equal leaves of equal rows are encoded once and counted, so very many copies of one long document are no task of their own.
    A null text counts as empty (no ids; both digests are those of nothing). Null and repeated ids stay as they are: each
    row gives a row. Other columns don't matter; an empty table gives no rows.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    is_long = F.coalesce(F.length("text") > leaf, F.lit(False))

    def short(batches):
        enc = tree_encoder(tokenizer)
        for batch in batches:
            found = []
            for part in slices(batch.column(1)):
                found += [_digest(enc, ids) for ids in enc.encode(part)]
            if found:
                yield from table(CODED, batch.column(0).to_pylist(), *map(list, zip(*found, strict=True))).to_batches()

    def cut(batches):
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                key, starts = hashlib.sha256(text.encode()).digest(), range(0, len(text), leaf)
                yield from table(LEAVES, [doc_id] * len(starts), [key] * len(starts), list(range(len(starts))), [text[a : a + leaf] for a in starts]).to_batches(max_chunksize=64)

    def encoded(batches):
        enc = tree_encoder(tokenizer)
        for batch in batches:
            texts = batch.column(4).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([enc.encode([t])[0] for t in texts], pa.binary())], [*batch.schema.names, "ids"])

    def folded(batches):
        enc = tree_encoder(tokenizer)
        last, copies, tree = None, 0, []

        def up() -> None:
            (n, a), (m, b) = tree[-2:]
            tree[-2:] = [(n + m, enc.joined(a, b))]

        def close():
            if tree:
                while len(tree) > 1:
                    up()
                n, ids, decoded = _digest(enc, tree[0][1][1])
                yield from table(CODED, *[list(repeat(x, copies)) for x in (last[0], n, ids, decoded)]).to_batches()

        for batch in batches:
            for doc_id, key, _, n, text, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (doc_id, key) != last:
                    yield from close()
                    last, copies, tree = (doc_id, key), n, []
                tree.append((1, (text, ids)))
                while len(tree) > 1 and tree[-2][0] == tree[-1][0]:
                    up()
        yield from close()

    leaves = rows.where(is_long).mapInArrow(cut, LEAVES).groupBy("doc_id", "key", "leaf").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    dealt = leaves.mapInArrow(encoded, "doc_id long, key binary, leaf long, copies long, text string, ids binary")
    joined = dealt.repartition(partitions(docs.sparkSession), "doc_id", "key").sortWithinPartitions("doc_id", "key", "leaf").mapInArrow(folded, CODED)
    return rows.where(~is_long).mapInArrow(short, CODED).unionByName(joined)


LEAVES = "doc_id long, key binary, leaf long, text string"


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return coded(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
