"""Periodic runs of words by recursive frequency splitting and lag scans.

A run is a stretch of consecutive words with smallest period q (words q apart
are the same), at least ``max(SHORTEST, 2 q)`` long, that neither neighbour
extends. Every word of a run occurs at least twice in it, so a word that
occurs once in a stretch of text belongs to no run inside that stretch: such
words split the stretch, the parts are counted anew, and so on until nothing
splits. Ordinary prose falls apart at once. What survives is scanned lag by lag
for stretches of at least q words that equal the word q further on:

* lags up to ``DENSE`` by comparing the whole segment with itself, shifted;
* longer ones, where such a stretch is longer than two aligned blocks of a
  power of two, by comparing numbered blocks first (exact ranks by doubling, no
  hashes) and then extending the blocks found to both sides by the same ranks.

A stretch inside a run of smaller period has that smaller period and is none of
its own; a run over a whole segment ends its scan, as by the theorem of Fine and
Wilf no other of a longer period fits in. Time is n log^2 n in a segment's
words, memory 4 n log n bytes in the longest surviving segment alone; texts are
handled one by one and never cut.

Defined results: a null or empty text has no words and no run; its collapsed
text is empty. Repeated rows are handled each, an empty table gives no row. Input
columns named ``runs`` or ``collapsed`` are replaced; all others stay.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHORTEST = 12
DENSE = 64
Run = tuple[int, int, int]      # start, length, period


def numbered(words: list[bytes]) -> np.ndarray:
    """The same number for the same word."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def surviving_segments(codes: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """(start, end) of the segments in which every word occurs twice at least."""
    at = np.arange(len(codes))
    segment = np.zeros(len(codes), np.int64)
    words = int(codes.max()) + 1 if len(codes) else 1
    while len(at) >= shortest:
        _, which, count = np.unique(segment * words + codes[at], return_inverse=True, return_counts=True)
        often = count[which] > 1
        if often.all():
            break
        at, segment = at[often], segment[often]
        cut = np.append(True, (np.diff(at) != 1) | (np.diff(segment) != 0))[:len(at)]
        segment = np.cumsum(cut) - 1
        long = np.bincount(segment, minlength=1) >= shortest
        at, segment = at[long[segment]], segment[long[segment]]
    if len(at) < shortest:
        return []
    ends = np.flatnonzero(np.append(np.diff(segment) != 0, True))
    starts = np.append(0, ends[:-1] + 1)
    return [(int(at[s]), int(at[e]) + 1) for s, e in zip(starts, ends)]


def stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values, ``least`` long or more."""
    edge = np.diff(np.concatenate(([0], equal.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= least
    return start[long], end[long]


class Found:
    """Runs of one segment found so far, by rising period."""

    def __init__(self, n: int):
        self.n, self.rows, self.whole = n, np.empty((16, 3), np.int64), False
        self.count = 0

    def add(self, start: int, end: int, period: int) -> None:
        old = self.rows[:self.count]
        if ((old[:, 0] <= start) & (old[:, 1] >= end)).any():
            return                                      # has a smaller period
        if self.count == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[self.count] = start, end, period
        self.count += 1
        self.whole |= start == 0 and end == self.n


def block_ranks(x: np.ndarray) -> list[np.ndarray]:
    """``ranks[k][i]``: the number of the 2^k words from i on; the last one
    either has no number twice or is as long as the segment allows."""
    ranks = [np.unique(x, return_inverse=True)[1].astype(np.int32)]
    while 2 << (len(ranks) - 1) <= len(x):
        old, half = ranks[-1].astype(np.int64), 1 << (len(ranks) - 1)
        if old.max() + 1 == len(old):
            break                                       # all blocks differ, longer ones too
        pair = old[:-half] * (old.max() + 1) + old[half:]
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
    return ranks


def extend(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words are the same from (i, j) on, and just before (i, j); i < j."""
    n = len(ranks[0])
    ahead, back = j.copy(), i.copy()
    shift = j - i
    for k in range(len(ranks) - 1, -1, -1):
        size, r = 1 << k, ranks[k]
        fits = np.flatnonzero(ahead + size <= n)
        same = fits[r[ahead[fits] - shift[fits]] == r[ahead[fits]]]
        ahead[same] += size
        fits = np.flatnonzero(back >= size)
        same = fits[r[back[fits] - size] == r[back[fits] + shift[fits] - size]]
        back[same] -= size
    return ahead - j, i - back


def long_lags(x: np.ndarray, found: Found, shortest: int = SHORTEST) -> None:
    """Runs with periods above ``DENSE``, added to ``found``."""
    n, ranks = len(x), block_ranks(x)
    scale = DENSE.bit_length() - 1
    while not found.whole and (1 << scale) <= n // 2 and scale - 1 < len(ranks):
        size = 1 << (scale - 1)
        low, high = max(1 << scale, DENSE + 1), min((2 << scale) - 1, n // 2)
        r = ranks[scale - 1]
        count = np.bincount(r)
        known = found.rows[:found.count]
        known = known[known[:, 2] <= size // 2]
        first, lag = [], []
        for t in range(0, n - size - low + 1, size):
            if count[r[t]] < 2:
                continue
            q = np.flatnonzero(r[t + low:t + high + 1] == r[t]) + low
            # both blocks in one run of a short period: the lag is a multiple of it
            inside = known[(known[:, 0] <= t) & (known[:, 1] >= t + size), 1]
            if len(inside):
                q = q[t + q + size > inside.max()]
            if len(q):
                first.append(np.full(len(q), t))
                lag.append(q)
        if first:
            t, q = np.concatenate(first), np.concatenate(lag)
            ahead, back = extend(ranks, t, t + q)
            start, end = t - back, t + q + ahead
            ok = end - start >= np.maximum(2 * q, shortest)
            for period, s, e in np.unique(np.stack([q[ok], start[ok], end[ok]], 1), axis=0):
                found.add(int(s), int(e), int(period))
        scale += 1


def segment_runs(x: np.ndarray, shortest: int = SHORTEST) -> list[Run]:
    """All runs of one segment."""
    found = Found(len(x))
    for q in range(1, min(len(x) // 2, DENSE) + 1):
        equal, least = x[q:] == x[:-q], max(q, shortest - q)
        if np.count_nonzero(equal) < least:
            continue
        for s, e in zip(*stretches(equal, least)):
            found.add(int(s), int(e) + q, q)
        if found.whole:
            break
    if not found.whole and len(x) // 2 > DENSE:
        long_lags(x, found, shortest)
    return [(int(s), int(e - s), int(q)) for s, e, q in found.rows[:found.count]]


def runs_of(words: list[bytes], shortest: int = SHORTEST) -> list[Run]:
    """All runs of a whole text's words, by start, then period."""
    if len(words) < shortest:
        return []
    codes = numbered(words)
    out = [(a + s, n, q) for a, b in surviving_segments(codes, shortest) for s, n, q in segment_runs(codes[a:b], shortest)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [w for w, k in zip(words, keep.tolist()) if k]


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8."""
    return text.encode().split() if text else []


def find_runs(docs: DataFrame, text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period by start, then period) and
    ``collapsed``, the text without repeated periods."""

    @F.pandas_udf("runs array<struct<start:long,length:long,period:long>>, collapsed string")
    def find(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            words = words_of(t)
            runs = runs_of(words, shortest)
            out.append(([{"start": s, "length": n, "period": q} for s, n, q in runs],
                        b" ".join(collapse(words, runs)).decode()))
        return pd.DataFrame(out, columns=["runs", "collapsed"])

    keep = [c for c in docs.columns if c not in ("runs", "collapsed")]
    return docs.withColumn("_found", find(F.col(text))).select(*keep, "_found.*")


def planted(doc_id: str | None, text: str | None) -> str | None:
    """The text with the repetition that its id calls for (every tenth checksum)."""
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    words = words_of(text) if h % 10 == 0 else []
    if not words:
        return text
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a:a + p] * -(-(n - a) // p)
    return b" ".join(words[:a] + tail[:n - a]).decode()


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents; a null id plants nothing."""

    @F.pandas_udf("string")
    def repeat(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([planted(i, t) for i, t in zip(ids, texts)], dtype=object)

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = docs.select("doc_id", repeat(F.col("doc_id").cast("string"), F.col("text")).alias("text"))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # greatest length, then smallest start, then smallest period: as structs compare
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"),
                                                   r["period"].alias("period")))
    got = find_runs(text).select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.array_min(order).alias("best"),
                                 F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"),
                                 F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return got.select("doc_id", "n_runs", F.col("best.start").alias("start"), (-F.col("best.minus")).alias("length"),
                      F.col("best.period").alias("period"),
                      F.expr("(best.minus * -1000) div best.period").alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256")
