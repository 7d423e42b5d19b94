"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once.

Both vocabularies split a text by a pattern (words, numbers, marks) and never merge over its bounds. So a text is
split alike here, each distinct piece goes through the library once, and a text's ids are gathered with numpy. That is
done where the split is certain: texts with letters or digits beyond Latin, or for the byte vocabulary with runs of
white space, go through the library whole. Before that, texts are cut at white space, and what stands between, which
is most of the time a word with its marks, is looked up as a whole; only new ones are split into pieces. Both tables
are caches: they are emptied when they grow.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow.compute as pc

_LATIN = "a-zA-ZÀ-ÖØ-öø-įı-ɏ"
_WITH_SPACE = re.compile(rf"'[{_LATIN}]+| ?[{_LATIN}]+| ?[0-9]+| ?[^{_LATIN}0-9\s]+|\s")
_NO_SPACE = re.compile(rf"'[{_LATIN}]+|[{_LATIN}]+|[0-9]+|[^{_LATIN}0-9\s]+")
_ODD = re.compile(rf"[^\W_{_LATIN}0-9]|[\x1c-\x1f]")
_TWO_SPACES = re.compile(r"\s\s")


_KEPT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Byte-level vocabularies write a byte as the character of that number if it can be seen, else as one from 256 on.
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _KEPT)}


def _two_spaces(text: str) -> bool:
    if text.isascii() and not any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"):
        return any(c in text for c in ("  ", "\n\n", " \n", "\n "))
    return bool(_TWO_SPACES.search(text))


class _Pieces(dict):
    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        k = self[piece] = len(self)
        self.new.append(piece)
        return k


class Encoder:
    """ids(texts) -> (all ids, number of each text's ids)."""

    MOST_PIECES = 500_000

    def __init__(self, path: str, special_as_text: bool = True):
        # A task has one core; threads of the library would each keep memory of their own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        one = lambda s: self.tokenizer.encode(s, add_special_tokens=False).ids
        self.spaced = one("a b") != one("a") + one("b")  # else white space is dropped, and case too if so:
        self.lower = one("Ab É") == one("ab é")
        words = [(" " if self.spaced else "") + w for w in ("word", "île", "straße", "zz")]
        if self._words(words)[0].tolist() != self._encode(words)[0].tolist():  # another kind of vocabulary
            self._words = self._encode
        self._clear_words()
        self._clear_pieces()

    def _clear_words(self) -> None:
        self.words, self.word_flat = _Pieces(), np.empty(0, np.uint32)
        self.word_offset, self.word_length = np.empty(0, np.int64), np.empty(0, np.int64)

    def _clear_pieces(self) -> None:
        self.pieces, self.flat = _Pieces(), np.empty(0, np.uint32)
        self.offset, self.length = np.empty(0, np.int64), np.empty(0, np.int32)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        length = np.array([len(x) for x in got], np.int32)
        return np.fromiter((i for x in got for i in x), np.uint32, int(length.sum())), length

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters only go to the library's merges at once: each is one unit of its split."""
        merge, space = self.tokenizer.model.tokenize, chr(_BYTES[0x20])
        got = [[t.id for t in merge(w.replace(" ", space) if w.isascii() else w.encode().decode("latin-1").translate(_BYTES))] for w in words]
        length = np.fromiter(map(len, got), np.int32, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(length.sum())), length

    def _learn(self) -> None:
        new, begin = self.pieces.new, len(self.length)
        if not new:
            return
        self.pieces.new = []
        word = np.array([p[1:].isalpha() and p[0] == " " if self.spaced else p.isalpha() for p in new], bool)
        length, offset, at = np.empty(len(new), np.int32), np.empty(len(new), np.int64), len(self.flat)
        chunks = [self.flat]
        for some, encode in ((np.flatnonzero(word), self._words), (np.flatnonzero(~word), self._encode)):
            for k in range(0, len(some), 1000):
                part = some[k : k + 1000]
                ids, n = encode([new[x] for x in part])
                chunks.append(ids)
                length[part], offset[part] = n, at + np.cumsum(n) - n
                at += len(ids)
        self.flat = np.concatenate(chunks)
        self.length, self.offset = np.r_[self.length, length], np.r_[self.offset, offset]
        assert len(self.length) == begin + len(new)

    def _certain(self, text: str) -> bool:
        if "\x00" in text or self.spaced and _two_spaces(text):
            return False
        if text.isascii():
            return not any(c in text for c in "\x1c\x1d\x1e\x1f")
        return not _ODD.search(text) and (self.spaced or unicodedata.is_normalized("NFC", text))

    def _split(self, text: str) -> list[str]:
        """At white space; if it counts, a space goes with what follows, and a line's end is by itself."""
        if not self.spaced:
            return (text.lower() if self.lower else text).split()
        return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")

    def _by_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of texts whose split is certain."""
        split = (_WITH_SPACE if self.spaced else _NO_SPACE).findall
        parts = [split(t) for t in texts]
        count = np.array([len(p) for p in parts], np.int64)
        at = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(parts)), np.int32, int(count.sum()))
        self._learn()
        return _gather(self.flat, self.offset, self.length, at, count)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > self.MOST_PIECES:
            self._clear_words()
        if len(self.pieces) > self.MOST_PIECES:
            self._clear_pieces()
        sure = [self._certain(t) for t in texts]
        parts = [self._split(t) if s else [] for t, s in zip(texts, sure, strict=True)]
        count = np.array([len(p) for p in parts], np.int64)
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(parts)), np.int32, int(count.sum()))
        if self.words.new:
            ids, length = self._by_pieces(self.words.new)
            self.words.new = []
            self.word_offset = np.r_[self.word_offset, len(self.word_flat) + np.cumsum(length) - length]
            self.word_flat, self.word_length = np.concatenate([self.word_flat, ids]), np.r_[self.word_length, length]
        body, sizes = _gather(self.word_flat, self.word_offset, self.word_length, at, count)
        if all(sure):
            return body, sizes
        whole = iter(e.ids for e in self.tokenizer.encode_batch_fast([t for t, s in zip(texts, sure, strict=True) if not s], add_special_tokens=False))
        bounds = np.r_[0, np.cumsum(sizes)]
        chunks = [body[bounds[k] : bounds[k + 1]] if s else np.array(next(whole), np.uint32) for k, s in enumerate(sure)]
        return np.concatenate(chunks), np.array([len(c) for c in chunks], np.int64)


def _gather(flat: np.ndarray, offset: np.ndarray, length: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of entries `at`, one after the other, and how many each text has, of `count` entries."""
    length = length[at]
    ends = np.cumsum(length, dtype=np.int64)
    sizes = np.diff(np.r_[0, ends][np.r_[0, np.cumsum(count)]])
    place = np.repeat(offset[at] - ends + length, length)
    place += np.arange(len(place))
    return flat[place].astype(np.uint32), sizes


_SHARED: dict[str, Encoder] = {}


def drop_shared() -> bool:
    """Forgets the shared encoder; whether there was one."""
    had = bool(_SHARED)
    _SHARED.clear()
    return had


def shared_encoder(path: str, most_pieces: int = Encoder.MOST_PIECES) -> Encoder:
    """One per worker process: later tasks need not learn their pieces again."""
    if path not in _SHARED:
        _SHARED.clear()
        _SHARED[path] = Encoder(path)
    _SHARED[path].MOST_PIECES = most_pieces
    return _SHARED[path]


def text_groups(column, limit: int = 2 << 20):
    """Slices (from, to, texts) of an Arrow text column with about so many bytes each."""
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)).tolist()
    begin, done = 0, 0
    for k, size in enumerate(sizes):
        if size - done >= limit or k + 1 == len(sizes):
            yield begin, k + 1, column.slice(begin, k + 1 - begin).to_pylist()
            begin, done = k + 1, size
