"""Mixing sources to target weights with soft domain membership.

A classifier learnt from a labelled table gives every document a posterior
p_dk over K domains. The document rates r_d >= 0 solve

    min  1/2 sum_k (sum_d w_d r_d p_dk - T_k)^2 / E_k  +  PULL/2 sum_d w_d (r_d - 1)^2

where w_d is the document's share of all tokens, E_k the domain's expected
share and T_k its target, so expected domain token totals match the targets
with rates near one.

Solved by distributed projected gradient: a step moves every rate against its
gradient p_d.y + PULL (r_d - 1), y_k = (sum_d w_d r_d p_dk - T_k) / E_k, sets
negative ones to zero and goes towards that point. Step lengths are spectral
(from the curvature met by the step before), and a step is taken whole unless
the objective, known exactly along it, would rise above its last ``MEMORY``
values; then it ends at the lowest point. A pass over the documents sums
K-vectors and a few numbers by Spark, whatever the number of documents. A rate
is a formula of its posterior and the steps so far, K + 2 numbers each, so no
rate table is carried along and a lost executor recomputes its part from the
written posteriors. The steps end when a projected gradient step of length one
would move the rates (root mean square by tokens) by less than ``TOLERANCE`` *
PULL, which bounds their distance from the optimum by about 2 ``TOLERANCE``.

Targets are shares, so one common factor on all rates is free: it is set so
that the documents whose likeliest domain is the reference domain are kept
once on average. A document is emitted floor(r + u) times, u a uniform hash of
its id.

Tokens are runs of letters, digits or signs.

Defined results: null and empty texts have no tokens, weigh nothing and get
the rate of their posterior; a domain without labelled rows gets a small
constant posterior; without labels every posterior is the same and every rate
one; rows with a null id share one u; repeated rows are mixed each; empty
tables give no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nbsvm
from .common import table, written
from .ngrams import NgramHasher

DOMAINS = ("clean", "low_quality", "toxic")
TARGETS = {"clean": 0.97, "low_quality": 0.02, "toxic": 0.01}
PULL, TOLERANCE, MEMORY = 0.01, 1e-5, 10


def domain_label() -> Column:
    """Domain number of a row of ``labels``."""
    return (F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1)
            .when(F.col("quality") == 1, 0))


def fit_domains(docs: DataFrame, labels: DataFrame) -> list[nbsvm.Model]:
    """One model per domain against the others."""
    rows = nbsvm.label_rows(docs, labels, domain_label())
    totals, counts = nbsvm.class_counts(rows, len(DOMAINS))
    feats, y, fold = nbsvm.sample_features(rows, min(1.0, nbsvm.SAMPLE / max(totals.sum(), 1)))
    models = []
    for k in range(len(DOMAINS)):
        pair = np.array([totals.sum() - totals[k], totals[k]])
        models.append(nbsvm.fit_binary(pair, np.array([counts.sum(axis=0) - counts[k], counts[k]]),
                                       feats, (y == k).astype(int), fold))
    return models


def posteriors(docs: DataFrame, models: list[nbsvm.Model]) -> DataFrame:
    """``docs`` with ``_mix``: (n_tokens, p), p summing to one."""
    dims = len(models[0].weights)
    shared = docs.sparkSession.sparkContext.broadcast(models)     # K * dims floats

    @F.pandas_udf("n_tokens long, p array<double>")
    def mix(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hasher = NgramHasher(dims)
        for batch in texts:
            found = list(hasher.many(batch))
            feats, n = [f for f, _ in found], [tokens for _, tokens in found]
            p = np.column_stack([m.scores(feats) for m in shared.value])
            p /= p.sum(axis=1, keepdims=True)
            yield pd.DataFrame({"n_tokens": n, "p": list(p)})

    return docs.withColumn("_mix", mix(F.col("text")))


@dataclass
class Step:
    """From rates r towards max(0, r - length * gradient), by ``share``."""
    y: np.ndarray
    length: float
    share: float


def _toward(p: np.ndarray, r: np.ndarray, y: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient at rates ``r`` and the way to the projected point."""
    g = p @ y + PULL * (r - 1)
    return g, np.maximum(0.0, r - length * g) - r


def rates_of(p: np.ndarray, steps: list[Step]) -> np.ndarray:
    """Rates of documents with posteriors ``p`` after ``steps``; one at first."""
    r = np.ones(len(p))
    for s in steps:
        r = r + s.share * _toward(p, r, s.y, s.length)[1]
    return r


def _matrix(b: pd.DataFrame, k: int) -> np.ndarray:
    return np.column_stack([b[f"p{i}"].to_numpy(np.float64) for i in range(k)])


def _flat(mixed: DataFrame, k: int) -> DataFrame:
    """n_tokens and p0.. of every row, which Arrow passes without boxing."""
    return mixed.select("_mix.n_tokens", *[F.col("_mix.p")[i].alias(f"p{i}") for i in range(k)])


def _sums(mixed: DataFrame, k: int, steps: list[Step], y: np.ndarray, length: float) -> np.ndarray:
    """By Spark, over all documents with weights w (tokens), rates r after
    ``steps`` and d the next step: the sums of w r p, w d p, w, w d^2, w g d,
    w (r - 1)^2, and w u^2 with u the step of length one."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(2 * k + 5)
        for b in batches:
            p, w = _matrix(b, k), b["n_tokens"].to_numpy(np.float64)
            r = rates_of(p, steps)
            g, d = _toward(p, r, y, length)
            u = _toward(p, r, y, 1.0)[1]
            out += np.concatenate([(w * r) @ p, (w * d) @ p,
                                   [w.sum(), w @ (d * d), w @ (g * d), w @ (r - 1) ** 2, w @ (u * u)]])
        yield pd.DataFrame({"at": range(len(out)), "s": out})

    got = _flat(mixed, k).mapInPandas(part, "at int, s double").groupBy("at").agg(F.sum("s"))
    out = np.zeros(2 * k + 5)
    for i, s in got.collect():
        out[i] = s
    return out


def solve(mixed: DataFrame, targets: dict[str, float] = TARGETS, reference: str = "clean",
          domains=DOMAINS) -> tuple[list[Step], np.ndarray, np.ndarray]:
    """Steps to the optimum, target shares and reached shares (of today's tokens)."""
    k = len(domains)
    steps: list[Step] = []
    first = _sums(mixed, k, steps, np.zeros(k), 0.0)
    total = first[2 * k]
    if total == 0:
        return steps, np.zeros(k), np.zeros(k)
    now = first[:k] / total
    e = np.maximum(now, 1e-9)
    t = np.array([targets[d] for d in domains])
    t = t / t.sum()
    t = t / t[domains.index(reference)] * e[domains.index(reference)]
    length, values = 1 / (1 + PULL), []
    while True:
        y = (now - t) / e
        sums = _sums(mixed, k, steps, y, length) / total
        way, (square, slope, off, unit) = sums[k:2 * k], sums[2 * k + 1:]
        if np.sqrt(unit) < TOLERANCE * PULL:
            return steps, t, now
        value = 0.5 * ((now - t) ** 2 / e).sum() + PULL / 2 * off
        curve = (way * way / e).sum() + PULL * square
        values = [*values, value][-MEMORY:]
        if curve <= 0 or -slope <= 1e-15 * value:     # no gain left that doubles can tell
            return steps, t, now
        share = 1.0 if value + slope + curve / 2 <= max(values) + 1e-4 * slope else min(1.0, -slope / curve)
        steps.append(Step(y, length, share))
        now = sums[:k] + share * way
        length = square / curve


def common_factor(mixed: DataFrame, steps: list[Step], reference: int = 0, k: int = len(DOMAINS)) -> float:
    """One over the mean rate of the reference domain's documents (by Spark)."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = 0, 0.0
        for b in batches:
            if len(b):
                p = _matrix(b, k)
                r = rates_of(p, steps)[p.argmax(axis=1) == reference]
                n, s = n + len(r), s + r.sum()
        yield pd.DataFrame({"n": [n], "s": [s]})

    n, s = _flat(mixed, k).mapInPandas(part, "n long, s double").agg(F.sum("n"), F.sum("s")).first()
    return n / s if n and s > 0 else 1.0


def with_rates(mixed: DataFrame, steps: list[Step], factor: float = 1.0) -> DataFrame:
    """``mixed`` with ``_rate`` and ``_copies``."""

    @F.pandas_udf("double")
    def rate(p: pd.Series) -> pd.Series:
        return pd.Series(factor * rates_of(np.stack(p.to_numpy()), steps) if len(p) else [], dtype=float)

    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (mixed.withColumn("_rate", rate(F.col("_mix.p")))
            .withColumn("_copies", F.floor(F.col("_rate") + u).cast("int")))


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``docs`` emitted as often as their rates say (same columns)."""
    mixed = written(posteriors(docs, fit_domains(docs, labels)), "mixing")
    steps, _, _ = solve(mixed, targets)
    out = with_rates(mixed, steps, common_factor(mixed, steps)).where("_copies > 0")
    again = F.explode(F.array_repeat(F.lit(0), F.col("_copies")))
    return out.withColumn("_again", again).select(*docs.columns)


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its posteriors, rate and number of copies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    models = fit_domains(docs, table(spark, sf_dir, "labels"))
    mixed = written(posteriors(docs, models).drop("text"), "mixing")
    steps, targets, reached = solve(mixed)
    factor = common_factor(mixed, steps)
    got = with_rates(mixed, steps, factor)
    return got.select(
        "doc_id", F.col("_mix.n_tokens").alias("n_tokens"),
        *[F.col("_mix.p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)],
        F.col("_rate").alias("rate"), F.col("_copies").alias("copies"),
        *[F.lit(float(x)).alias(f"{what}_{d}") for what, v in (("target", targets * factor), ("reached", reached * factor))
          for d, x in zip(DOMAINS, v)])
