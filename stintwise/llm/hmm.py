"""Hidden Markov language model over words.

Tokens are ASCII-lower-cased words and one end per text. The training rows'
word counts c (all of them, a table that grows with the corpus) give the base
score and the model's vocabulary: the ``VOCAB`` most frequent words are
symbols of their own, all other words share one symbol, inside which a word
has the probability (c + 0.1) / (their total), an unknown word 0.1 of it.
So every symbol sequence times its words' shares is one proper distribution.

*Baum-Welch*: each round, every task runs scaled forward and backward
recursions over its training texts, in segments of ``SEGMENT`` tokens, all
in step. A segment shares one token with the next, so every transition, every
token and every start of a text is counted once; inner segments start from the
stationary distribution. Expected counts are summed across partitions
(emissions by blocks of the vocabulary) and give the next round's tables, until
a round gains less than ``GAIN`` of the likelihood, or after ``ROUNDS``.
*Smoothing*: every state's emissions get the base's 0.1 a word, in the
state's share of all tokens, and ``PRIOR`` tokens of the base distribution, so an
unknown word has its base probability in every state.
*Scores*: a scaled forward recursion over each whole text, never cut.

Defined results: null and empty texts are one end token; a null id is not
held out and trains; without training rows there is one unknown word of
probability one; repeated rows train and are scored each (a row is a text, ids
need not differ); an empty table gives no row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

STATES, VOCAB, ROUNDS, SEGMENT, GAIN = 6, 1 << 17, 4, 96, 1e-3
ADD, PRIOR, BLOCK = 0.1, 50.0, 4096
END = b""          # no word is empty
_SLICE = 400_000   # tokens that a recursion with kept rows holds at once
_TOGETHER = 4_000_000


@dataclass
class Tables:
    start: np.ndarray      # (S,)
    move: np.ndarray       # (S, S)
    emit: np.ndarray       # (symbols, S), P(symbol | state)


def held_out(key: str = "doc_id") -> Column:
    crc = F.crc32(F.col(key).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(10)) == 0, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of the training rows, the end token among them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            c: Counter = Counter()
            for t in batch["text"]:
                c.update(words_of(t))
            c[END] += len(batch)
            yield pd.DataFrame({"word": list(c), "c": list(c.values())})

    part = docs.where(~held_out()).select("text").mapInPandas(count, "word binary, c long")
    return part.groupBy("word").agg(F.sum("c").alias("c"))


def encoded(docs: DataFrame, vocab: dict[bytes, int]) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, ids, rare): symbols of every text as
    int32 bytes, and its words without a symbol of their own with their
    number of occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)    # at most VOCAB words
    other = len(vocab)

    @F.pandas_udf("n_tokens long, ids binary, rare array<struct<word:binary,n:int>>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in texts:
            n, ids, rare = [], [], []
            for t in batch:
                words = words_of(t)
                words.append(END)
                got = [known.get(w, other) for w in words]
                n.append(len(got))
                ids.append(np.array(got, np.int32).tobytes())
                few = Counter(w for w, i in zip(words, got) if i == other)
                rare.append([{"word": w, "n": k} for w, k in few.items()])
            yield pd.DataFrame({"n_tokens": n, "ids": ids, "rare": rare})

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out().alias("held_out"),
                       encode(F.col("text")).alias("e")).select("row", "doc_id", "held_out", "e.*")


def first_tables(counts: np.ndarray, states: int = STATES, seed: int = 11) -> Tables:
    """Sticky transitions and emissions around the symbol frequencies."""
    random = np.random.default_rng(seed)
    emit = (counts[:, None] + 1e-3) * random.gamma(1.0, size=(len(counts), states))
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Tables(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def in_step(lengths: np.ndarray, size: int = _SLICE) -> Iterator[np.ndarray]:
    """Row numbers, longest first, in groups of about ``size`` tokens."""
    order, at, held = np.argsort(-lengths, kind="stable"), 0, 0
    for k, i in enumerate(order):
        held += lengths[i]
        if held >= size:
            yield order[at:k + 1]
            at, held = k + 1, 0
    if at < len(order):
        yield order[at:]


def forward(seqs: list[np.ndarray], t: Tables, keep: bool = False, inner: np.ndarray | None = None):
    """Scaled forward recursion of sequences sorted longest first, in step.
    Returns log probabilities and, if kept, each step's scaled rows and scales.
    ``inner`` sequences go on within a text: they start from the stationary
    distribution, and their first token is another's last and not counted."""
    lengths = np.array([len(s) for s in seqs])
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")   # rows longer than the step
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate(seqs)
    total, rows = np.zeros(len(seqs)), []
    first = t.start if inner is None else np.where(inner[:, None], stationary(t.move), t.start)
    a = None
    for k in range(steps):
        n = active[k]
        e = t.emit[flat[starts[:n] + k]]
        a = (first * e) if k == 0 else (a[:n] @ t.move) * e
        c = a.sum(axis=1)
        a /= c[:, None]
        total[:n] += np.log(c) if k or inner is None else np.where(inner, 0.0, np.log(c))
        if keep:
            rows.append((a, c, e))
    return total, rows, active, starts, flat


def stationary(move: np.ndarray) -> np.ndarray:
    """The distribution of states that ``move`` leaves as it is."""
    n = len(move)
    rows = np.vstack([move.T - np.eye(n), np.ones(n)])
    p = np.maximum(np.linalg.lstsq(rows, np.append(np.zeros(n), 1.0), rcond=None)[0], 0.0)
    return p / p.sum()


def expected_counts(seqs: list[np.ndarray], t: Tables,
                    inner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, transitions and emissions of the sequences, and their log
    probability; see ``forward`` for ``inner``."""
    inner = np.zeros(len(seqs), bool) if inner is None else inner
    states = len(t.start)
    start, move, emit, score = np.zeros(states), np.zeros_like(t.move), np.zeros(t.emit.shape), 0.0
    lengths = np.array([len(s) for s in seqs])
    for group in in_step(lengths):
        total, rows, active, starts, flat = forward([seqs[i] for i in group], t, keep=True, inner=inner[group])
        score += total.sum()
        gamma = np.empty((len(flat), states))
        b = np.ones((0, states))
        for k in range(len(rows) - 1, -1, -1):
            a, c, _ = rows[k]
            n = active[k]
            if k + 1 < len(rows):
                m = active[k + 1]
                _, c2, e2 = rows[k + 1]
                onward = b * e2 / c2[:, None]
                move += a[:m].T @ onward * t.move
                full = np.ones((n, states))
                full[:m] = onward @ t.move.T
                b = full
            else:
                b = np.ones((n, states))
            gamma[starts[:n] + k] = a * b
        start += gamma[starts[~inner[group]]].sum(axis=0)
        gamma[starts[inner[group]]] = 0.0
        for s in range(states):
            emit[:, s] += np.bincount(flat, gamma[:, s], minlength=len(emit))
    return start, move, emit, score


def segments(ids: list[bytes], size: int = SEGMENT) -> tuple[list[np.ndarray], np.ndarray]:
    """Pieces of ``size`` transitions, each but a text's first beginning with the
    last token of the one before, and which of them do."""
    out, inner = [], []
    for b in ids:
        seq = np.frombuffer(b, np.int32)
        cuts = range(0, max(len(seq) - 1, 1), size)
        out.extend(seq[i:i + size + 1] for i in cuts)
        inner.extend(i > 0 for i in cuts)
    return out, np.array(inner, bool)


def smoothed(emit: np.ndarray, frequency: np.ndarray, words: np.ndarray) -> np.ndarray:
    """P(symbol | state) from expected counts. ``words``: how many words, the
    unknown one among them, each symbol stands for."""
    share = emit.sum(axis=0) / max(emit.sum(), 1e-300)
    emit = emit + ADD * words[:, None] * share + PRIOR * frequency[:, None]
    return emit / emit.sum(axis=0)


def baum_welch_round(coded: DataFrame, t: Tables, frequency: np.ndarray, words: np.ndarray) -> tuple[Tables, float]:
    """One round over all training rows: the next tables and the log probability
    of the rows by the present ones. Partial counts are summed by Spark;
    what comes back is bounded by the tables' size."""
    shared = coded.sparkSession.sparkContext.broadcast(t)
    states, symbols = len(t.start), len(frequency)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, any_rows = shared.value, False
        start, move, emit, score = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)), 0.0
        for batch in batches:
            seqs, inner = segments(batch["ids"])
            if seqs:
                any_rows = True
                s, m, e, x = expected_counts(seqs, now, inner)
                start += s
                move += m
                emit += e
                score += x
        if any_rows:
            parts = {-1: np.concatenate([start, move.ravel(), [score]])}
            parts |= {i: emit[i * BLOCK:(i + 1) * BLOCK].ravel() for i in range(-(-symbols // BLOCK))}
            yield pd.DataFrame({"block": list(parts), "v": [v.astype(np.float32).tobytes() if k >= 0 else v.tobytes()
                                                            for k, v in parts.items()]})

    def add(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind, out = (np.float32 if key[0] >= 0 else np.float64), None
        for batch in rows:
            for v in batch["v"]:
                x = np.frombuffer(v, kind).astype(np.float64)
                out = x if out is None else out + x
        yield pd.DataFrame({"block": [key[0]], "v": [out.tobytes()]})

    parts = coded.where("NOT held_out").select("ids").mapInPandas(part, "block int, v binary")
    got = dict(parts.groupBy("block").applyInPandas(add, "block int, v binary").collect())
    shared.unpersist()
    if not got:
        return t, 0.0
    head = np.frombuffer(got[-1])
    start, move, score = head[:states] + 1, head[states:-1].reshape(states, states) + 1, float(head[-1])
    emit = np.concatenate([np.frombuffer(got[i]).reshape(-1, states) for i in range(-(-symbols // BLOCK))])
    return Tables(start / start.sum(), move / move.sum(axis=1, keepdims=True), smoothed(emit, frequency, words)), score


def sequence_scores(coded: DataFrame, t: Tables, symbol_log: np.ndarray) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, symbols_score, base_log): the log10
    probability of every whole symbol sequence, and its sum of ``symbol_log``."""
    shared = coded.sparkSession.sparkContext.broadcast((t, symbol_log))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, logs = shared.value
        for rows in gathered(batches):
            seqs = [np.frombuffer(b, np.int32) for b in rows.pop("ids")]
            out = np.zeros(len(seqs))
            for group in in_step(np.array([len(s) for s in seqs]), _TOGETHER):
                out[group] = forward([seqs[i] for i in group], tables)[0]
            yield rows.assign(symbols_score=out / np.log(10), base_log=[logs[s].sum() for s in seqs])

    return coded.select("row", "doc_id", "held_out", "n_tokens", "ids").mapInPandas(
        score, "row long, doc_id long, held_out boolean, n_tokens long, symbols_score double, base_log double")


def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches put together to about ``_TOGETHER`` tokens, so that long texts
    are stepped through next to many others."""
    held, tokens = [], 0
    for b in batches:
        held.append(b)
        tokens += int(b["n_tokens"].sum())
        if tokens >= _TOGETHER:
            yield pd.concat(held, ignore_index=True)
            held, tokens = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def score_documents(docs: DataFrame, states: int = STATES, vocab_size: int = VOCAB, rounds: int = ROUNDS) -> DataFrame:
    docs = docs.select("doc_id", "text")
    counts = written(word_counts(docs), "word-counts")
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    n, v = int(n or 0), int(v)
    # the end token always has a symbol, then the most frequent words
    top = counts.orderBy(F.col("word") != F.lit(END), F.desc("c"), "word").limit(vocab_size).collect()
    vocab, c = {bytes(r["word"]): i for i, r in enumerate(top)}, np.array([r["c"] for r in top], np.float64)
    rest = v - len(vocab)                            # known words without a symbol
    other = n - c.sum() + ADD * (rest + 1)           # their mass and the unknown word's
    frequency = np.append(c, other)
    frequency /= frequency.sum()

    coded = written(encoded(docs, vocab), "symbols")
    t, last = first_tables(frequency, states), None
    words = np.append(np.ones(len(vocab)), rest + 1)
    for _ in range(rounds if n else 0):
        t, score = baum_welch_round(coded, t, frequency, words)
        if last is not None and score - last < GAIN * abs(last):
            break
        last = score

    # words without a symbol: their counts by an equi-join on the word
    rare = coded.select("row", F.explode("rare").alias("w")).select("row", "w.word", "w.n")
    seen = rare.join(counts, "word", "left").select(
        "row", "n", F.coalesce("c", F.lit(0)).alias("c"))
    seen = seen.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + F.lit(ADD))).alias("rare_log"), F.sum("n").alias("rare_n"),
        F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("rare_known"))

    total = np.log10(n + ADD * (v + 1))
    got = sequence_scores(coded, t, np.append(np.log10(c + ADD), 0.0)).join(seen, "row", "left")
    rare_log, rare_n = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("rare_n", F.lit(0))
    return got.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_tokens") - rare_n + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_log") + rare_log - F.col("n_tokens") * F.lit(float(total))).alias("base_score"),
        (F.col("symbols_score") + rare_log - rare_n * F.lit(float(np.log10(other)))).alias("score"))


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
