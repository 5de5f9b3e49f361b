"""Naive Bayes support vector classifier over n-gram indicators.

1. *Log-count ratios*: over **all** labelled training texts, each class's
   n-gram presence counts are summed by feature (distributed, one partial
   count per task and feature) and give r = log((p / |p|) / (q / |q|)).
2. *Linear hinge-loss model*: indicators scaled by r, fitted by dual
   coordinate descent (L2 penalty, one dual variable per row, boxed by C) on a
   bounded sample of at most about ``SAMPLE`` labelled rows, taken by a hash of
   the id. This bound is the only sample; counts and scores cover every row.
3. *Probability*: a logistic curve over the margin, fitted on a fifth of the
   sample that the descent does not see.

Labels are never an input of a score, nor are id, language and source.

Defined results: null and empty texts score as the intercept alone; without
labels, or with one class only, every text gets the smoothed class share;
several labels of one document count as their smallest; null labels and null
ids do not train; repeated documents are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, table
from .ngrams import DIMS, NgramHasher, presence_counts

SAMPLE, EPOCHS, COST, SMOOTH = 6_000, 12, 1.0, 4.0
ACCEPT = 0.3       # predicted is 1 from this score on


@dataclass
class Model:
    """weights (per feature, already scaled by r), intercept, logistic curve."""
    weights: np.ndarray
    intercept: float
    slope: float
    offset: float

    def margins(self, feats: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(f) for f in feats])
        if not sizes.sum():
            return np.full(len(feats), self.intercept)
        flat = self.weights[np.concatenate(feats)].astype(np.float64)
        ends = np.concatenate([[0.0], np.cumsum(flat)])
        stop = np.cumsum(sizes)
        norm = np.sqrt(np.maximum(sizes, 1))
        return (ends[stop] - ends[stop - sizes]) / norm + self.intercept

    def scores(self, feats: list[np.ndarray]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margins(feats) + self.offset, -40, 40)))


def constant_model(share: float, dims: int) -> Model:
    return Model(np.zeros(dims, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST,
                 epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept of min 1/2 |w|^2 + cost * sum hinge(y w.x), with
    x = r over the present features, divided by the root of their number, and
    one constant feature for the intercept."""
    w, b, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    xs = [ratio[f] / np.sqrt(max(len(f), 1)) for f in rows]
    q = np.array([x @ x + 1.0 for x in xs])
    share = max((y > 0).mean(), 1e-9)
    box = np.where(y > 0, cost * 0.5 / share, cost * 0.5 / max(1 - share, 1e-9))   # balanced classes
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            f, x = rows[i], xs[i]
            g = y[i] * (w[f] @ x + b) - 1.0
            new = min(max(alpha[i] - g / q[i], 0.0), box[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * x
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, b


def logistic_curve(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | margin), by Newton steps with smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + c, -30, 30)))
        d, s = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, [(d * m).sum() + 1e-3 * (a - 1), d.sum()])
        a, c = a - step[0], c - step[1]
        if abs(step).max() < 1e-6:
            break
    return (float(a), float(c)) if np.isfinite([a, c]).all() and a > 0 else (1.0, 0.0)


def class_counts(rows: DataFrame, classes: int, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(texts per class, presence counts per class and feature) of ``rows``
    (text, label 0..classes-1). Counts are summed by Spark; what comes back is
    bounded by the model's size, ``classes * dims`` numbers."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, seen = NgramHasher(dims), np.zeros(classes, np.int64)
        counts = [np.zeros(dims, np.int64) for _ in range(classes)]
        for batch in batches:
            for k in range(classes):
                texts = batch.loc[batch["label"] == k, "text"]
                seen[k] += len(texts)
                counts[k] += presence_counts((f for f, _ in hasher.many(texts)), dims)
        for k in range(classes):
            f = np.flatnonzero(counts[k])
            yield pd.DataFrame({"label": k, "feature": np.append(f, -1), "n": np.append(counts[k][f], seen[k])})

    got = (rows.select("text", "label").mapInPandas(partial, "label int, feature int, n long")
           .groupBy("label", "feature").agg(F.sum("n").alias("n")).toArrow())
    totals, counts = np.zeros(classes), np.zeros((classes, dims))
    label, feature, n = (got[c].to_numpy() for c in ("label", "feature", "n"))
    whole = feature < 0
    totals[label[whole]] = n[whole]
    counts[label[~whole], feature[~whole]] = n[~whole]
    return totals, counts


def sample_features(rows: DataFrame, share: float, dims: int = DIMS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Features, labels and a 0..4 fold of the rows whose id hash is below
    ``share``; the caller sets the share so that their number is bounded."""
    key = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 20))

    @F.pandas_udf("binary")
    def feats(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = NgramHasher(dims)
        for batch in texts:
            yield pd.Series([f.tobytes() for f, _ in hasher.many(batch)], dtype=object)

    got = (rows.where(key < F.lit(int(share * (1 << 20)) + 1))
           .select("doc_id", "label", feats(F.col("text")).alias("f"), F.pmod(key, F.lit(5)).alias("fold"))
           .toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")]))
    return ([np.frombuffer(f, np.int32) for f in got["f"].to_pylist()], got["label"].to_numpy().astype(np.int64),
            got["fold"].to_numpy().astype(np.int64))


def fit_binary(totals: np.ndarray, counts: np.ndarray, feats: list[np.ndarray], y: np.ndarray,
               fold: np.ndarray) -> Model:
    """A model of label 1 against label 0 from class counts and the sample."""
    dims = counts.shape[1]
    share = (totals[1] + 1) / (totals.sum() + 2)
    if min(totals) == 0 or len(np.unique(y)) < 2:
        return constant_model(share, dims)
    # SMOOTH texts more per feature, split as the classes are: an unseen feature has ratio 0
    part = totals / totals.sum()
    ratio = np.log((counts[1] + SMOOTH * part[1]) / part[1]) - np.log((counts[0] + SMOOTH * part[0]) / part[0])
    sign = np.where(y > 0, 1.0, -1.0)
    learn, hold = fold != 0, fold == 0
    if len(np.unique(y[hold])) < 2 or len(np.unique(y[learn])) < 2:
        learn = hold = np.ones(len(y), bool)
    w, b = dual_descent([f for f, k in zip(feats, learn) if k], sign[learn], ratio)
    model = Model((w * ratio).astype(np.float32), b, 1.0, 0.0)
    model.slope, model.offset = logistic_curve(model.margins([f for f, k in zip(feats, hold) if k]), sign[hold])
    return model


def label_rows(docs: DataFrame, labels: DataFrame, label: Column, keep: Column | None = None) -> DataFrame:
    """(doc_id, text, label) of documents with a label; ``label`` is a column
    over ``labels``. The label side is counted and broadcast only if small."""
    one = (labels.select("doc_id", label.cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
           .groupBy("doc_id").agg(F.min("label").alias("label")))
    if keep is not None:
        one = one.where(keep)
    return docs.select("doc_id", "text").join(broadcast_if_small(one, labels.count(), 64), "doc_id")


def training_fold(key: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5: 0 is held out."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5))


def fit_quality(docs: DataFrame, labels: DataFrame) -> Model:
    rows = label_rows(docs, labels, F.col("quality"), training_fold() != 0).where("label IN (0, 1)")
    totals, counts = class_counts(rows, 2)
    share = min(1.0, SAMPLE / max(totals.sum(), 1))
    return fit_binary(totals, counts, *sample_features(rows, share))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (P of label 1) and ``predicted``."""
    dims = len(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast(model)   # dims floats: 1 MB

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher, fitted = NgramHasher(dims), shared.value
        for batch in texts:
            yield pd.Series(fitted.scores([f for f, _ in hasher.many(batch)]))

    out = docs.withColumn("score", score(F.col("text")))
    return out.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def op10_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select(
        "doc_id", (F.coalesce(training_fold(), F.lit(1)) == 0).alias("held_out"), "score", "predicted")
