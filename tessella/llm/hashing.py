"""64-bit hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

from tessella.llm.text import words

VOCABULARY = 300_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v

    def of(self, text: str | None, table: bytes) -> np.ndarray:
        if len(self) > VOCABULARY:
            self.clear()
        w = words(text, table)
        return np.fromiter(map(self.__getitem__, w), np.uint64, len(w))


hashes = WordHashes()


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + m]) * MIX
        out ^= out >> np.uint64(29)
    return out
