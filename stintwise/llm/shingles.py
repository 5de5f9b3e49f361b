"""Distinct word shingles of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MEMO_SIZE = 150_000


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Text to its set of ``WORDS``-word shingles. A-Z are lower-cased, words
    are runs without ASCII white space; a shorter text is one shingle, one
    without words (or null) none."""

    def __init__(self, words: int = WORDS):
        self.words, self.memo = words, {}

    def _code(self, word: bytes) -> int:
        if len(self.memo) >= _MEMO_SIZE:
            self.memo.clear()
        h = self.memo[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        memo, code = self.memo, self._code
        h = np.array([memo.get(w) or code(w) for w in (text or "").encode().lower().split()], dtype=np.uint64)
        n = len(h)
        if not n:
            return h
        k = min(self.words, n)
        out = np.full(n - k + 1, np.uint64(k), np.uint64)
        for i in range(k):
            out = mix64(out * _MUL + h[i:n - k + 1 + i])
        return np.unique(out)
