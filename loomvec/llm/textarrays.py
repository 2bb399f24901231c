"""Texts as arrays of code points, so that words are found and hashed many documents at once."""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 250_000  # characters worked on at once; changes no result
BLANK = 0x20
#: An odd base of word hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_kept: list[Callable] = []


def release() -> None:
    """Gives memory that is free but still held by the allocators back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def begin_step(keeps: Callable | None) -> None:
    """Drops what this worker has kept for a step before that kept something else. A function by
    itself, so that workers find _kept in this module and not as a copy sent with each task."""
    while _kept and _kept[-1] is not keeps:
        _kept.pop().cache_clear()
    if keeps and not _kept:
        _kept.append(keeps)


def lean(run: Callable, keeps: Callable | None = None) -> Callable:
    """run for mapInArrow, with free memory given back after each batch: a worker serves one step after
    another, and what each held at its peak would add up. keeps: a cached function whose
    results stay until the worker gets another step."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                release()

        begin_step(keeps)
        yield from run(each())
        release()

    return lean_run


@lru_cache(2)
def lower_table(kinds: str = "LM") -> np.ndarray:
    """By code point: its lower-case form, a blank where its category begins with none of
    kinds, letters and marks where not told otherwise. Forms of several characters stay as they are."""
    lower = np.full(0x110000, BLANK, dtype=np.uint32)
    for c in range(0x110000):
        if unicodedata.category(ch := chr(c))[0] in kinds:
            small = ch.lower()
            lower[c] = ord(small) if len(small) == 1 else c
    return lower


def text_slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of rows of about so many bytes with their texts; a longer text is a range by
    itself. Only a range's texts are Python strings at a time."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, begin = np.cumsum(size), 0
    while begin < len(size):
        before = int(ends[begin] - size[begin])
        end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield begin, end, column.slice(begin, end - begin).to_pylist()
        begin = end


class Words:
    """The words of some texts, runs of letters and marks, or of other kinds, in lower case.

    chars: all texts one after another with a blank before, between and after them, and for
    all that is no letter; at: places of letters in chars; word_at: places in `at`
    where words begin; char_from, char_to: a word's range counted from all texts'
    start; text_at: the same of texts; text_words: where each text's words begin, with the end."""

    def __init__(self, texts: list[str | None], kinds: str = "LM"):
        self.source = np.frombuffer(("\n".join(t or "" for t in texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.chars = np.concatenate([[np.uint32(BLANK)], lower_table(kinds)[self.source]])
        letter = self.chars != BLANK
        self.at = np.flatnonzero(letter)
        self.word_at = np.flatnonzero(~letter[self.at - 1])
        self.char_from = self.at[self.word_at] - 1
        self.char_to = self.at[~letter[self.at + 1]]
        sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
        self.text_at = np.concatenate([[0], np.cumsum(sizes)])
        self.text_words = np.searchsorted(self.char_from, self.text_at)

    def __len__(self) -> int:
        return len(self.word_at)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word that depends on the word alone."""
        if not len(self):
            return np.zeros(0, np.uint64)
        n = np.diff(self.word_at, append=len(self.at))
        longest = int(n.max())
        within = np.arange(len(self.at)) - np.repeat(self.word_at, n)
        powers = np.cumprod(np.full(longest + 1, BASE, dtype=np.uint64))
        return mixed(np.add.reduceat(self.chars[self.at].astype(np.uint64) * powers[within], self.word_at))

    def prefix_hashes(self, length: int) -> np.ndarray:
        """Hashes of the first so many letters; 0 for shorter words."""
        n = self.char_to - self.char_from
        total = np.zeros(len(self), dtype=np.uint64)
        begin = self.char_from + 1
        for i, power in enumerate(np.cumprod(np.full(length, BASE, dtype=np.uint64))):
            total += self.chars[np.minimum(begin + i, len(self.chars) - 1)].astype(np.uint64) * power
        return np.where(n >= length, mixed(total), np.uint64(0))

    def lowered(self) -> str:
        """The texts in lower case with blanks for what is no letter, as char_from and char_to count."""
        return self.chars[1:].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def mixed(h: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(words: list[str]) -> np.ndarray:
    """hashes() of words given one by one."""
    found = Words(words)
    if len(found) != len(words):
        raise ValueError("not all are words")
    return found.hashes()
