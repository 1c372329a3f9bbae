"""Hashes of words and of runs of words, over many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the mixing steps.
M1, M2, M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * M1
    h = (h ^ (h >> np.uint64(33))) * M2
    return h ^ (h >> np.uint64(33))


class WordHashes(dict):
    """64-bit hash of each word, remembered for a bounded number of words."""

    def __init__(self, keep: int = 150_000):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and words per text."""
        if len(self) > self.keep:
            self.clear()
        counts = np.fromiter(map(len, split), np.int64, len(split))
        return np.fromiter((self[w] for words in split for w in words), np.uint64, int(counts.sum())), counts


def words(text: str, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space; ``lower`` changes A-Z alone. Bytes do just this."""
    data = text.encode()
    return (data.lower() if lower else data).split()


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on, as far as there are n; doubles the length it has."""
    have, size = mix(h), 1
    while size < n and len(have):
        step = min(size, n - size)
        have = mix(have[: len(have) - step] * M3 + have[step:]) if len(have) > step else have[:0]
        size += step
    return have
