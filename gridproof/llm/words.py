"""Encoding whole texts word by word: each distinct word of a task is encoded once."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text held as Python words at one time, and words remembered, per task.
CHARS_AT_ONCE = 2_000_000
WORDS_KEPT = 300_000


def give_back() -> None:
    """Return freed memory to the system, as a worker process outlives its task and its stage."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def parts(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = CHARS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of the batches, of about ``chars`` bytes of text or one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + chars, "right"))
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()
    give_back()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = CHARS_AT_ONCE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """``parts``, each with its texts (null: empty)."""
    for part in parts(batches, text, chars):
        yield part, [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[starts[k] : starts[k] + lengths[k]] for each k, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class WordPool:
    """Ids of words in one flat array. ``encode`` takes distinct words and gives (flat ids, ids per word)."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], keep: int = WORDS_KEPT):
        self.encode, self.keep = encode, keep
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def _add(self, words: list[str]) -> None:
        flat, lengths = self.encode(words)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        first = self.used + np.cumsum(lengths) - lengths
        self.starts, self.lengths = np.concatenate([self.starts, first]), np.concatenate([self.lengths, lengths])
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.used += len(flat)

    def texts(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, given as their words, and ids per text."""
        if len(self.index) > self.keep:
            self._clear()
        new = set(chain.from_iterable(split)).difference(self.index)
        if new:
            self._add(list(new))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        lengths = self.lengths[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return gather(self.ids, self.starts[at], lengths), np.diff(ends[bounds])
