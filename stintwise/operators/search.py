"""The model search in one pass: grid, split, refit and prediction from moments.

Per measure the label is regressed on two features, experience and the
measure's previous-season value, with an elastic-net penalty: 30 candidates are
compared on a held-out quarter and the best is refitted on all rows.

A linear model with two features needs only the rows' count, means and
covariances, so one aggregation per (measure, fold) replaces a pass per
candidate and fold:

* ``fold`` deals rows to training and validation by a digest of (name, year):
  the same split for any file or partition layout.
* ``fold_moments`` is the one pass over the data, and two rows a measure are all
  that comes back from it. Moments of all rows are the merged ones.
* ``solve`` is a candidate in closed form. On scaled features the penalised loss
  is convex and its minimum lies at one of nine points, one per pair of signs
  (negative, zero, positive) of the two coefficients; the point with the least
  loss is the solution.
* A candidate's validation error is a polynomial of its coefficients in the
  validation moments.

The chosen models, a few numbers each, become literals of the prediction, which
is a projection of the rows asked for, without a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predict import ELASTIC_NET, REG_PARAMS

TRAIN, VALIDATION = "train", "validation"


def fold(name: Column, year: Column) -> Column:
    """Three quarters train: by the first hex digit of the MD5 of "name|year"."""
    digest = F.md5(F.concat_ws("|", F.coalesce(name.cast("string"), F.lit("")),
                               F.coalesce(year.cast("string"), F.lit(""))).cast("binary"))
    return F.when(F.substring(digest, 1, 1).isin("0", "4", "8", "c"), VALIDATION).otherwise(TRAIN)


def training_rows(ml: DataFrame, stats: Sequence[str], year) -> DataFrame:
    """(stat, fold, x1, x2, y) of one season's rows, one row a measure. Rows with
    an undefined feature or label do not train."""
    each = F.explode(F.array(*[
        F.struct(F.lit(s).alias("stat"), F.col("exp").cast("double").alias("x1"),
                 F.col(f"{s.lower()}0").cast("double").alias("x2"), F.col(s.lower()).cast("double").alias("y"))
        for s in stats]))
    rows = ml.where(F.col("year") == year).select(fold(F.col("name"), F.col("year")).alias("fold"), each.alias("r"))
    return rows.select("fold", "r.*").where("x1 IS NOT NULL AND x2 IS NOT NULL AND y IS NOT NULL")


def fold_moments(rows: DataFrame) -> DataFrame:
    """Count, means, variances and covariances (population) per (stat, fold)."""
    return rows.groupBy("stat", "fold").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("x1").alias("m1"), F.avg("x2").alias("m2"),
        F.avg("y").alias("my"), F.var_pop("x1").alias("v1"), F.var_pop("x2").alias("v2"), F.var_pop("y").alias("vy"),
        F.covar_pop("x1", "x2").alias("c12"), F.covar_pop("x1", "y").alias("c1y"), F.covar_pop("x2", "y").alias("c2y"))


@dataclass(frozen=True)
class Moments:
    """Moments of one set of rows (population variances and covariances)."""

    n: float
    m1: float
    m2: float
    my: float
    v1: float
    v2: float
    vy: float
    c12: float
    c1y: float
    c2y: float

    def __add__(self, other: Moments) -> Moments:
        """The moments of two disjoint sets of rows together."""
        n, a, b = self.n + other.n, self.n / (self.n + other.n), other.n / (self.n + other.n)
        d1, d2, dy = self.m1 - other.m1, self.m2 - other.m2, self.my - other.my

        def mix(x: float, y: float, product: float = 0.0) -> float:
            return a * x + b * y + a * b * product

        return Moments(n, mix(self.m1, other.m1), mix(self.m2, other.m2), mix(self.my, other.my),
                       mix(self.v1, other.v1, d1 * d1), mix(self.v2, other.v2, d2 * d2), mix(self.vy, other.vy, dy * dy),
                       mix(self.c12, other.c12, d1 * d2), mix(self.c1y, other.c1y, d1 * dy), mix(self.c2y, other.c2y, d2 * dy))

    def squared_error(self, b0: float, b1: float, b2: float) -> float:
        """Mean squared error of a model over the rows."""
        bias = self.my - b0 - b1 * self.m1 - b2 * self.m2
        spread = (self.vy + b1 * b1 * self.v1 + b2 * b2 * self.v2 + 2 * b1 * b2 * self.c12
                  - 2 * b1 * self.c1y - 2 * b2 * self.c2y)
        return max(spread, 0.0) + bias * bias


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def solve(m: Moments, reg: float, intercept: bool, net: float) -> tuple[float, float, float]:
    """(intercept, two coefficients) of the penalised least squares over rows
    with moments ``m``. Features and label are divided by their deviations;
    without an intercept, moments about zero take the place of covariances. A
    feature without deviation, or any if the label has none, has coefficient 0."""
    s1, s2, sy = sqrt(m.v1), sqrt(m.v2), sqrt(m.vy)

    def about(c: float, p: float, q: float) -> float:
        return c if intercept else c + p * q

    ridge, lasso = _ratio(reg * (1 - net), sy), _ratio(reg * net, sy)
    g11 = _ratio(about(m.v1, m.m1, m.m1), m.v1) + ridge
    g22 = _ratio(about(m.v2, m.m2, m.m2), m.v2) + ridge
    g12 = _ratio(about(m.c12, m.m1, m.m2), s1 * s2)
    a1, a2 = _ratio(about(m.c1y, m.m1, m.my), s1 * sy), _ratio(about(m.c2y, m.m2, m.my), s2 * sy)

    def loss(w: tuple[float, float]) -> float:
        return (0.5 * (g11 * w[0] * w[0] + g22 * w[1] * w[1]) + g12 * w[0] * w[1] - a1 * w[0] - a2 * w[1]
                + lasso * (abs(w[0]) + abs(w[1])))

    points, det = [(0.0, 0.0)], g11 * g22 - g12 * g12
    for i in (-1, 1):
        u = a1 - i * lasso
        points += [(_ratio(u, g11), 0.0), (0.0, _ratio(a2 - i * lasso, g22))]
        for j in (-1, 1):
            v = a2 - j * lasso
            points.append((_ratio(g22 * u - g12 * v, det), _ratio(g11 * v - g12 * u, det)))
    w1, w2 = min(points, key=loss)
    b1, b2 = _ratio(w1 * sy, s1), _ratio(w2 * sy, s2)
    return (m.my - b1 * m.m1 - b2 * m.m2 if intercept else 0.0), b1, b2


def season_moments(rows: DataFrame) -> dict[str, dict[str, Moments]]:
    """stat -> fold -> moments: the one pass, two rows a measure to the driver."""
    out: dict[str, dict[str, Moments]] = {}
    for r in fold_moments(rows).collect():
        stat, which, *values = r
        out.setdefault(stat, {})[which] = Moments(*values)
    return out


@dataclass(frozen=True)
class Model:
    """A candidate: its place in the grid, validation error and coefficients."""

    stat: str
    reg: float
    intercept: bool
    net: float
    rmse: float
    b0: float
    b1: float
    b2: float

    def prediction(self) -> Column:
        return (F.lit(self.b0) + F.lit(self.b1) * F.col("exp").cast("double")
                + F.lit(self.b2) * F.col(f"{self.stat.lower()}0"))


def candidates(stat: str, folds: dict[str, Moments]) -> list[Model]:
    """Every candidate fitted on the training fold, with its validation error, in
    the order of the grid; none if a fold has no rows."""
    if len(folds) < 2:
        return []
    out = []
    for reg in REG_PARAMS:
        for intercept in (True, False):
            for net in ELASTIC_NET:
                b = solve(folds[TRAIN], reg, intercept, net)
                out.append(Model(stat, reg, intercept, net, sqrt(folds[VALIDATION].squared_error(*b)), *b))
    return out


def refitted(best: Model, folds: dict[str, Moments]) -> Model:
    """The candidate fitted on training and validation rows together."""
    b = solve(folds[TRAIN] + folds[VALIDATION], best.reg, best.intercept, best.net)
    return Model(best.stat, best.reg, best.intercept, best.net, best.rmse, *b)


def fit(ml: DataFrame, stats: Sequence[str], year) -> dict[str, Model]:
    """Models of the measures, from the rows of one season of the feature table:
    per measure the candidate with the least validation error (the first of the
    grid if equal), refitted. A measure without training or validation rows has
    none."""
    out = {}
    for stat, folds in season_moments(training_rows(ml, stats, year)).items():
        tried = candidates(stat, folds)
        if tried:
            out[stat] = refitted(min(tried, key=lambda m: m.rmse), folds)
    return out


def predict(ml: DataFrame, models: dict[str, Model], stats: Sequence[str], year) -> DataFrame:
    """name, year, then prediction_<stat> and label_<stat> of every row of a
    season; NULL where a feature, a label or the model is missing."""
    out = [F.col("name"), F.col("year")]
    for s in stats:
        p = models[s].prediction() if s in models else F.lit(None).cast("double")
        out += [p.alias(f"prediction_{s}"), F.col(s.lower()).alias(f"label_{s}")]
    return ml.where(F.col("year") == year).select(*out)


def one_prediction(predicted: DataFrame, stat: str) -> DataFrame:
    return predicted.select("name", "year", F.col(f"prediction_{stat}").alias("prediction"),
                            F.col(f"label_{stat}").alias("label"))


def summed(predicted: DataFrame, stats: Sequence[str]) -> DataFrame:
    """Predictions and labels summed over the measures, row by row."""
    def total(kind: str) -> Column:
        out = F.col(f"{kind}_{stats[0]}")
        for s in stats[1:]:
            out = out + F.col(f"{kind}_{s}")
        return out.alias(kind)

    return predicted.select("name", "year", total("prediction"), total("label"))
