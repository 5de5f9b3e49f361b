"""The one-pass model search against pyspark.ml, and its split."""

import random

import pytest
from pyspark.sql import functions as F

from stintwise.operators import predict, search


def features(spark, n=160, seed=3, noise=0.6):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        e, prev = rnd.randrange(8), rnd.gauss(0.3, 1.2)
        rows.append((f"e{i}", 1, e, prev, 0.7 * prev - 0.05 * e + 0.2 + rnd.gauss(0, noise), rnd.gauss(1, 1), rnd.gauss(0, 1)))
        rows.append((f"e{i}", 2, e + 1, rnd.gauss(0, 1), None, rnd.gauss(0, 1), None))
    return spark.createDataFrame(rows, "name string, year int, exp int, zw10 double, zw1 double, zw20 double, zw2 double")


def ml_fit(rows, reg, intercept, net):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(labelCol="y", regParam=reg, fitIntercept=intercept, elasticNetParam=net, tol=1e-12, maxIter=500).fit(
        VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(rows))


@pytest.mark.parametrize("stat", ["zw1", "zw2"])
def test_candidates_equal_pyspark_ml(spark, stat):
    rows = search.training_rows(features(spark), [stat], 1).cache()
    got = {(m.reg, m.intercept, m.net): m for m in search.candidates(stat, search.season_moments(rows)[stat])}
    assert len(got) == 30
    train, held = rows.where("fold = 'train'").cache(), rows.where("fold = 'validation'").cache()
    for key in [(0.1, True, 0.0), (0.1, False, 1.0), (0.01, True, 0.5), (0.01, False, 0.25), (0.001, True, 1.0),
                (0.1, True, 0.75)]:
        m, r = ml_fit(train, *key), got[key]
        assert [r.b1, r.b2, r.b0] == pytest.approx([*m.coefficients, m.intercept], abs=2e-6)
        error = held.select(F.sqrt(F.avg((F.col("y") - r.b0 - r.b1 * F.col("x1") - r.b2 * F.col("x2")) ** 2))).first()[0]
        assert r.rmse == pytest.approx(error, rel=1e-12)
    best = min(got.values(), key=lambda r: r.rmse)
    model = search.fit(features(spark), [stat], 1)[stat]
    assert (model.reg, model.intercept, model.net) == (best.reg, best.intercept, best.net)
    m = ml_fit(rows, model.reg, model.intercept, model.net)
    assert [model.b1, model.b2, model.b0] == pytest.approx([*m.coefficients, m.intercept], abs=2e-6)


def test_split_does_not_depend_on_layout(spark):
    f = features(spark)
    a = search.fit(f.repartition(7, "zw10"), ["zw1"], 1)["zw1"]
    b = search.fit(f.coalesce(1).orderBy(F.desc("name")), ["zw1"], 1)["zw1"]
    assert (a.reg, a.intercept, a.net) == (b.reg, b.intercept, b.net)
    assert [a.b0, a.b1, a.b2] == pytest.approx([b.b0, b.b1, b.b2], abs=1e-12)
    share = f.where("year = 1").select(F.avg((search.fold(F.col("name"), F.col("year")) == "train").cast("int"))).first()[0]
    assert 0.65 < share < 0.85


def test_predictions_and_their_sum(spark):
    f = features(spark)
    models = search.fit(f, predict.MEASURES, 1)
    p = search.predict(f, models, predict.MEASURES, 2)
    assert "Join" not in p._jdf.queryExecution().optimizedPlan().toString()
    one = {s: search.one_prediction(p, s) for s in predict.MEASURES}
    want = {r["name"]: r["prediction"] for r in predict.combine_predictions(one).collect()}
    got = {r["name"]: r["prediction"] for r in search.summed(p, predict.MEASURES).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in got)


def test_dirty_and_degenerate_rows(spark):
    schema = "name string, year int, exp int, zw10 double, zw1 double"
    rows = [(f"e{i}", 1, i % 3, None if i % 5 == 0 else 1.0, None if i % 7 == 0 else 2.0) for i in range(60)]
    rows += [(None, 1, 1, 1.0, 2.0), ("p", 2, None, 1.0, None), ("q", 2, 3, 1.0, None), ("q", 2, 3, 1.0, None)]
    f = spark.createDataFrame(rows, schema)
    m = search.fit(f, ["zw1"], 1)["zw1"]                        # constant feature and label
    assert (m.b1, m.b2, m.b0, m.rmse) == (0.0, 0.0, pytest.approx(2.0), pytest.approx(0.0, abs=1e-9))
    got = sorted(map(tuple, search.one_prediction(search.predict(f, {"zw1": m}, ["zw1"], 2), "zw1").collect()))
    assert got == [("p", 2, None, None), ("q", 2, pytest.approx(2.0), None), ("q", 2, pytest.approx(2.0), None)]
    assert search.fit(f.limit(0), ["zw1"], 1) == {}
    assert search.predict(f, {}, ["zw1"], 2).where("prediction_zw1 IS NULL").count() == 3
