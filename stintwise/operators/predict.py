"""Next-season prediction from the prior-season feature table.

Per measure: features (experience, the measure's previous-season value),
label (this season's value); train on one season, predict the next.

* ``ols_two_feature``: unpenalised least squares in closed form from
  population (co)variances, one aggregation (partial + final) over the data.
* ``search`` (its own module): the model search in one aggregation.
* ``fit_next_season``: the same search with ``pyspark.ml``, a job per fit:
  VectorAssembler + LinearRegression in a Pipeline, a 30-candidate grid
  (regParam x fitIntercept x elasticNetParam) chosen by TrainValidationSplit
  (75 % train, RMSE), with a fixed seed. With two features the default
  solver is weighted least squares: one pass over the data per fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The reference's model grid and split ratio.
REG_PARAMS = (0.1, 0.01, 0.001)
ELASTIC_NET = (0.0, 0.25, 0.5, 0.75, 1.0)
TRAIN_RATIO = 0.75
MEASURES = ("zw1", "zw2")


def split(ml: DataFrame, stat: str, lo, hi=None) -> DataFrame:
    """Rows with ``lo <= year < hi`` (``hi`` defaults to lo + 1):
    name, year, exp, <stat>0, label."""
    hi = lo + 1 if hi is None else hi
    s = stat.lower()
    return (ml.filter((F.col("year") >= lo) & (F.col("year") < hi))
            .select("name", "year", "exp", f"{s}0", F.col(s).alias("label")))


def ols_two_feature(df: DataFrame, x1: str, x2: str, y: str = "label") -> DataFrame:
    """y = intercept + b1 x1 + b2 x2 by least squares, in one aggregation.

    Rows with a NULL in any of the three columns are left out.
    """
    d = df.filter(F.col(x1).isNotNull() & F.col(x2).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x1).cast("double").alias("x1"), F.col(x2).cast("double").alias("x2"),
        F.col(y).cast("double").alias("y"))
    m = d.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("x1").alias("m1"), F.avg("x2").alias("m2"), F.avg("y").alias("my"),
        F.var_pop("x1").alias("v1"), F.var_pop("x2").alias("v2"),
        F.covar_pop("x1", "x2").alias("c12"),
        F.covar_pop("x1", "y").alias("c1y"), F.covar_pop("x2", "y").alias("c2y"),
    )
    det = F.col("v1") * F.col("v2") - F.col("c12") * F.col("c12")
    b1 = F.try_divide(F.col("v2") * F.col("c1y") - F.col("c12") * F.col("c2y"), det)
    b2 = F.try_divide(F.col("v1") * F.col("c2y") - F.col("c12") * F.col("c1y"), det)
    return m.select(
        F.col("n"),
        b1.alias("coef_1"), b2.alias("coef_2"),
        (F.col("my") - b1 * F.col("m1") - b2 * F.col("m2")).alias("intercept"),
    )


def fit_next_season(train: DataFrame, test: DataFrame, stat: str, seed: int = 42,
                    parallelism: int = 8):
    """Fit the reference's grid on ``train``, predict ``test``.

    Returns (predictions: name, year, prediction, label; best model). Rows
    without a feature or label do not train; every row of ``test`` is in the
    output, with a NULL prediction if a feature is missing.
    ``parallelism`` candidates are fitted at once (each fit is one small
    aggregation job, so the grid is bound by job latency, not data).
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit

    s0 = f"{stat.lower()}0"
    assembler = VectorAssembler(inputCols=["exp", s0], outputCol="features", handleInvalid="error")
    lr = LinearRegression(featuresCol="features", labelCol="label")
    grid = (ParamGridBuilder()
            .addGrid(lr.regParam, list(REG_PARAMS))
            .addGrid(lr.fitIntercept, [True, False])
            .addGrid(lr.elasticNetParam, list(ELASTIC_NET))
            .build())
    tvs = TrainValidationSplit(
        estimator=Pipeline(stages=[assembler, lr]),
        evaluator=RegressionEvaluator(labelCol="label", metricName="rmse"),
        estimatorParamMaps=grid, trainRatio=TRAIN_RATIO, seed=seed, parallelism=parallelism)
    whole = F.col("exp").isNotNull() & F.col(s0).isNotNull()
    model = tvs.fit(train.filter(F.col("label").isNotNull() & whole))
    rows = test.withColumn("_whole", whole).fillna(0, subset=["exp", s0])
    pred = model.transform(rows).select(
        "name", "year", F.when(F.col("_whole"), F.col("prediction")).alias("prediction"), "label")
    return pred, model


def combine_predictions(preds: dict[str, DataFrame]) -> DataFrame:
    """Sum predictions and labels over measures, joined on (name, year)."""
    out = None
    for stat, p in preds.items():
        p = p.select("name", "year", F.col("prediction").alias(f"p_{stat}"),
                     F.col("label").alias(f"l_{stat}"))
        out = p if out is None else out.join(p, ["name", "year"], "full")
    stats = list(preds)
    pred = sum((F.col(f"p_{s}") for s in stats[1:]), F.col(f"p_{stats[0]}"))
    label = sum((F.col(f"l_{s}") for s in stats[1:]), F.col(f"l_{stats[0]}"))
    return out.select("name", "year", pred.alias("prediction"), label.alias("label"))


def predicted_rank(combined: DataFrame, n: int = 100) -> DataFrame:
    """The first n by prediction (descending), ties by name."""
    return combined.orderBy(F.col("prediction").desc_nulls_last(), F.col("name")).limit(n)


def prediction_rmse(pred: DataFrame) -> DataFrame:
    """RMSE and row count over rows that have a label (placeholder rows of the
    season after the last have none; the reference counts them as 0)."""
    d = pred.filter(F.col("label").isNotNull() & F.col("prediction").isNotNull())
    return d.agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg((F.col("prediction") - F.col("label")) ** 2)).alias("rmse"),
    )
