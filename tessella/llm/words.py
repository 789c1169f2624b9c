"""Hashes of words and of runs of five words."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5
WORDS_HELD = 150_000
#: An odd multiplier, and the multipliers and shifts of a well-known 64-bit finalizer.
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2, SHIFT = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


HASHES = _WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> SHIFT)) * MIX_1
    x = (x ^ (x >> SHIFT)) * MIX_2
    return x ^ (x >> SHIFT)


def word_hashes(text: str) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(HASHES.__getitem__, words), "u8", len(words))


def shingle_hashes(text: str, n: int = SHINGLE_WORDS) -> np.ndarray:
    """A hash for each run of ``n`` words, in order. A text of fewer words has one run, of all its words; one without words none."""
    words = word_hashes(text)
    n = min(n, len(words))
    if not n:
        return words
    runs = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        runs *= ODD
        runs += words[i : len(words) - n + 1 + i]
    return mixed(runs + np.uint64(n))
