"""Whole-text encoding with a public tokenizer, whose merge model gets each unseen piece of a word once, many in one call."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Letters of the texts that are split here: ASCII and the accented ones up to U+012F. Fixed values.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
PLAIN = rf"[\n\x20-\x7e{LETTERS}]*"
PROBES = ["It's 12 of\n\nthe  ÉTÉ's,  'tis!! a_b-c\n", " x", "Straße, niño... 3.14 ### d'accord I'LL", "end. ", "end  "]
#: Words are parted by this when they are split together; no plain word holds it.
BETWEEN = "\0"
#: Code points of a word that is split with others.
SHORT = 48
#: Pieces in one call of the merge model.
TOGETHER = 2000


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write a byte that prints as itself, the others as U+0100 and on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: 256 + i for i, b in enumerate(others)}


class Seen(dict):
    """Values by word, made when first asked for; those of very long words aren't kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        ids = self.make(word)
        if len(word) <= 48:
            self[word] = ids
        return ids


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of values of these starts and lengths, one after the other."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _put(held: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """The values written behind the first at numbers held, in a longer array if need be."""
    if at + len(values) > len(held):
        held, before = np.empty(2 * (at + len(values)), held.dtype), held
        held[:at] = before[:at]
    held[at : at + len(values)] = values
    return held


class WordEncoder:
    """Encodes texts with the tokenizers library, remembering the ids of pieces of words already seen.

    Byte-pair merges never cross the border between a non-space character and a following
    space or line feed, so the ids of a text are the ids of its words, in order. A word takes
    the blanks before it along. Texts with other white space than these two are
    encoded as a whole, since there the pre-tokenizer may look further.

    The distinct words of all texts of a call that consist of plain letters, digits and marks are split into the
    pre-tokenizer's pieces here, and those pieces that are new go to the library's merge model together; any other word goes
    through the whole library. Where that split doesn't fit a vocabulary (as seen on PROBES), all words do.
    """

    def __init__(self, path: str, limit: int = 700_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.limit = limit
        self.known = Seen(lambda word: self._new(word))
        self.bytes = _byte_letters()
        self.letters = np.array([self.bytes.get(b, b) for b in range(256)], "<u4")
        self.letters[ord(BETWEEN)] = ord(" ")
        self.merges = Tokenizer(self.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        #: Symbols that a token stands for, by id.
        suffix, vocabulary = getattr(self.model, "end_of_word_suffix", None) or "", self.tokenizer.get_vocab(with_added_tokens=True)
        self.symbols = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.symbols[list(vocabulary.values())] = [len(t.removesuffix(suffix)) for t in vocabulary]
        self._forget_pieces()
        self.other_space = re.compile(r"[^\S \n]").search
        #: Bytes that other white space starts with, among others.
        self.rare = np.isin(np.arange(256), [*range(9), *range(11, 32), 0xC2, 0xE1, 0xE2, 0xE3])
        self.plain = re.compile(PLAIN).fullmatch
        self.all_plain = re.compile(rf"(?:{PLAIN}{BETWEEN})*").fullmatch
        self.lower = self.tokenizer.normalizer is not None
        marks = rf"[^\s{LETTERS}0-9{BETWEEN}]+"
        split = rf"{ENDINGS}|[{LETTERS}]+|[0-9]|{marks}" if self.lower else rf"{ENDINGS}| ?[{LETTERS}]+| ?[0-9]+| ?{marks}|\s+(?![^\s{BETWEEN}])|\s+"
        self.split = re.compile(rf"{split}|{BETWEEN}").findall
        self.fits = True
        self.fits = self.encode(PROBES) == self._whole(PROBES)

    def _forget_pieces(self) -> None:
        """Of each piece its number; the ids of all, and where those of each number start and how many they are. The first is BETWEEN, without ids."""
        self.pieces: dict[str, int] = {BETWEEN: 0}
        self.ids, self.starts, self.lengths, self.used = np.zeros(0, self.dtype), np.zeros(1, np.int64), np.zeros(1, np.int64), 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _merged(self, pieces: list[str]) -> tuple[list[int], np.ndarray]:
        """The ids of these pieces, and how many each has."""
        raw = self.letters[np.frombuffer(BETWEEN.join(pieces).encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids = self.merges.encode_batch_fast([raw], add_special_tokens=False)[0].ids
        ends = np.cumsum([len(p) for p in raw.split(" ")])
        reached = np.cumsum(self.symbols[ids])
        at = np.searchsorted(reached, ends)
        if len(reached) and at[-1] == len(reached) - 1 and (reached[at] == ends).all():
            return ids, np.diff(at, prepend=-1)
        # a symbol without a token
        each = [[t.id for t in self.model.tokenize(p)] for p in raw.split(" ")]
        return [i for e in each for i in e], np.array([len(e) for e in each])

    def _merged_all(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [], [np.zeros(0, np.int64)]
        for i in range(0, len(pieces), TOGETHER):
            some, many = self._merged(pieces[i : i + TOGETHER])
            ids.append(np.array(some, self.dtype))
            lengths.append(many)
        return np.concatenate([np.zeros(0, self.dtype), *ids]), np.concatenate(lengths)

    def _learn(self, pieces: list[str]) -> None:
        n, (ids, lengths) = len(self.pieces), self._merged_all(pieces)
        self.ids = _put(self.ids, self.used, ids)
        self.starts = _put(self.starts, n, self.used + np.cumsum(lengths) - lengths)
        self.lengths = _put(self.lengths, n, lengths)
        self.used += len(ids)
        self.pieces.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def _split(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words, each with BETWEEN behind it, and how many each has."""
        found = self.split(joined.lower() if self.lower else joined)
        new = [p for p in dict.fromkeys(found) if p not in self.pieces]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        lengths = self.lengths[at]
        return _gather(self.ids, self.starts[at], lengths), np.diff(np.cumsum(lengths)[at == 0], prepend=0)

    def _is_plain(self, word: str) -> bool:
        return len(word) <= SHORT and "<|" not in word and self.plain(word) is not None

    def _new(self, word: str) -> bytes:
        if self.fits and "<|" not in word and self.plain(word):
            return self._merged_all(self.split(word.lower() if self.lower else word))[0].tobytes()
        return self._whole([word])[0]

    def _words(self, held: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of words in some order, and for each word their start and number."""
        words = held.to_numpy(zero_copy_only=False).tolist()
        joined = BETWEEN.join([*words, ""])
        if self.fits and "<|" not in joined and joined.count(BETWEEN) == len(words) and (pc.max(pc.binary_length(held)).as_py() or 0) <= SHORT and self.all_plain(joined):
            ids, lengths = self._split(joined)
            return ids, np.cumsum(lengths) - lengths, lengths
        plain = np.array([self.fits and self._is_plain(w) for w in words], bool)
        found, lengths = self._split("".join([w + BETWEEN for w, p in zip(words, plain, strict=True) if p]))
        others = [np.frombuffer(self.known[w], self.dtype) for w, p in zip(words, plain, strict=True) if not p]
        order = np.argsort(~plain, kind="stable")
        lengths = np.concatenate([lengths, np.array([len(i) for i in others], np.int64)])
        starts, by_word = np.empty_like(lengths), np.empty_like(lengths)
        starts[order], by_word[order] = np.cumsum(lengths) - lengths, lengths
        return np.concatenate([found, *others]), starts, by_word

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of self.dtype."""
        if len(self.known) > self.limit:
            self.known.clear()
        if len(self.pieces) > self.limit:
            self._forget_pieces()
        held = pa.array(texts, pa.large_string())
        borders = np.frombuffer(held.buffers()[1], np.int64, len(texts) + 1)
        raw = np.frombuffer(held.buffers()[2] or b"", np.uint8, borders[-1])
        blank = (raw == 32) | (raw == 10)
        begins = np.zeros(len(raw) + 1, bool)
        begins[1:-1] = blank[1:] & ~blank[:-1]
        for i in np.unique(np.searchsorted(borders, np.flatnonzero(self.rare[raw]), side="right") - 1):
            if self.other_space(texts[i]):
                begins[borders[i] : borders[i + 1]] = False
        begins[borders] = True
        starts = np.flatnonzero(begins)  # the last one is the end of all
        words = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(raw)).dictionary_encode()
        ids, at, lengths = self._words(words.dictionary)
        places = words.indices.to_numpy()
        each = lengths[places]
        found = _gather(ids, at[places], each)
        ends = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(starts, borders)].tolist()
        return [found[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary and Python worker."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Lets go of this worker's encoders and the words they remember: for stages that follow the encoding and need none."""
    _encoders.clear()


def slices(texts, size: int = 640, most: int = 2 << 20):
    """The texts of an Arrow array in lists of at most size, and of at most so many bytes (but for longer texts), so that what one call holds stays small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        upto = np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")
        n = int(min(max(upto - i, 1), size))
        yield [t or "" for t in texts.slice(i, n).to_pylist()]
        i += n
