"""Hashed n-gram indicators of whole texts, for the classifiers."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

DIMS = 1 << 18
#: Characters taken at once (a longer text goes alone).
_SLICE = 1 << 18
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Letters, digits and spaces are code points below this one.
_ASSIGNED = 0x32400
SPACE, LETTER, DIGIT, SIGN, UNDERSCORE = range(5)


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: its class, its lower case (of one character, else
    itself), and 1 for a capital, 2 for another cased letter."""
    kind, lower, case = [], [], []
    for at in range(_ASSIGNED):
        c = chr(at)
        small = c.lower()
        if c.isspace():
            kind.append(SPACE)
        elif c == "_":
            kind.append(UNDERSCORE)
        elif c.isdecimal():
            kind.append(DIGIT)
        else:
            kind.append(LETTER if c.isalnum() else SIGN)
        lower.append(ord(small) if len(small) == 1 else at)
        case.append(1 if c.isupper() else 2 if c.islower() or c.istitle() else 0)
    rest = np.arange(_ASSIGNED, sys.maxunicode + 1)         # no letters there, so signs
    return (np.append(np.array(kind, np.uint8), np.full(len(rest), SIGN, np.uint8)),
            np.append(lower, rest).astype(np.uint32), np.append(case, 0 * rest).astype(np.uint8))


@cache
def _powers() -> np.ndarray:
    """A factor for each place in a token; they repeat after 65,536 places."""
    return np.cumprod(np.full(1 << 16, _P))


class NgramHasher:
    """Sorted distinct feature numbers below ``dims`` of a text's token
    unigrams and bigrams (runs of letters, digits, signs or underscores,
    lower-cased character by character) and of the trigrams of its token
    shapes: letters, capitals, digits or signs, and whether a token repeats
    the one before it.

    The texts of a slice are one array of code points: classes and lower case
    come from tables, a token is a run of one class, and its number a
    polynomial of its characters, so nothing is done per token in Python."""

    def __init__(self, dims: int = DIMS):
        self.dims = dims

    def __call__(self, text: str | None) -> np.ndarray:
        return next(self.many([text]))[0]

    def many(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, int]]:
        """Features and number of tokens of every text, in order."""
        some, held = [], 0
        for t in texts:
            t = t or ""
            if some and held + len(t) > _SLICE:
                yield from self._slice(some)
                some, held = [], 0
            some.append(t)
            held += len(t)
        if some:
            yield from self._slice(some)

    def _slice(self, texts: list[str]) -> Iterator[tuple[np.ndarray, int]]:
        h, start = token_numbers("\n".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        at = np.append(0, np.searchsorted(start, ends))
        for i in range(len(texts)):
            yield self._features(h[at[i]:at[i + 1]]), int(at[i + 1] - at[i])

    def _features(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.empty(0, np.int32)
        pairs = h[:-1] * _P + (h[1:] ^ (h[1:] >> np.uint64(29)))
        shape = (h & np.uint64(7)).astype(np.int32)
        shape[1:] += 8 * (h[1:] == h[:-1])
        three = np.flatnonzero(np.bincount((shape[:-2] * 16 + shape[1:-1]) * 16 + shape[2:] + 1)).astype(np.uint64)
        every = np.concatenate([h, pairs, three << np.uint64(33)]) * _P >> np.uint64(40)     # 24 bits
        out = np.sort(every.astype(np.int32) % np.int32(self.dims))
        return out[np.append(True, out[1:] != out[:-1])]


def token_numbers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The number of every token of ``text``, its shape in the low three bits,
    and the place where it starts."""
    kinds, lowers, cases = _characters()
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds[c]
    edge = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])) if len(c) else np.empty(0, np.int64)
    size = np.diff(np.append(edge, len(c)))
    token = kind[edge] != SPACE
    if not token.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    place = np.arange(len(c)) - np.repeat(edge, size)
    h = np.add.reduceat(lowers[c] * _powers()[place & 0xFFFF], edge)[token]
    case = cases[c]
    capitals = (np.add.reduceat(case == 1, edge, dtype=np.int64) > 0) & (np.add.reduceat(case == 2, edge, dtype=np.int64) == 0)
    kind = kind[edge]
    shape = np.where(kind == LETTER, np.where(capitals & (size > 3), 2, 1), np.where(kind == DIGIT, 3, 4))[token]
    h = (h ^ (h >> np.uint64(32))) * _Q
    h ^= h >> np.uint64(29)
    return h & ~np.uint64(7) | shape.astype(np.uint64), edge[token]


def presence_counts(feats: Iterable[np.ndarray], dims: int) -> np.ndarray:
    """How many of the texts hold each feature."""
    out = np.zeros(dims, np.int64)
    for f in feats:
        out[f] += 1
    return out
