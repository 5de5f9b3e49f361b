"""Hand-worked scores (FIXTURES.md section 8) and score invariants."""

import math

import pytest
from pyspark.sql import functions as F

from stintwise.operators.scores import season_scores, weighted_impacts
from stintwise.spec import NEGATED, PLAIN, WEIGHTED, Measure, SeasonSpec

ONE = SeasonSpec(raw=("x",), measures=(Measure("X", PLAIN, "x"),), carry=())


def _rows(spark, rows, cols):
    return spark.createDataFrame(rows, cols)


def test_plain_zscore_and_normalised(spark):
    df = _rows(spark, [("a", 1, 1.0), ("b", 1, 2.0), ("c", 1, 3.0)], ["name", "year", "x"])
    out = {r["name"]: r for r in season_scores(df, ONE).collect()}
    r15 = math.sqrt(1.5)
    assert out["a"]["zX"] == pytest.approx(-r15)
    assert out["b"]["zX"] == pytest.approx(0.0)
    assert out["c"]["zX"] == pytest.approx(r15)
    assert [out[k]["nX"] for k in "abc"] == pytest.approx([-1.0, 0.0, 1.0])
    assert out["c"]["zTOT"] == pytest.approx(r15)
    assert out["c"]["nTOT"] == pytest.approx(1.0)


def test_weighted_impact_and_second_stage(spark):
    spec = SeasonSpec(raw=("pct", "att"), measures=(Measure("W", WEIGHTED, "pct", "att"),), carry=())
    df = _rows(spark, [("a", 1, 0.2, 10.0), ("b", 1, 0.4, 10.0), ("c", 1, 0.6, 20.0)],
               ["name", "year", "pct", "att"])
    imp = {r["name"]: r["impact_W"] for r in weighted_impacts(df, spec).collect()}
    assert [imp[k] for k in "abc"] == pytest.approx([-2.0, 0.0, 4.0])
    # second stage: z of the impacts, mean 2/3
    m = 2.0 / 3.0
    sd = math.sqrt(((-2 - m) ** 2 + (0 - m) ** 2 + (4 - m) ** 2) / 3)
    out = {r["name"]: r for r in season_scores(df, spec).collect()}
    assert out["a"]["zW"] == pytest.approx((-2 - m) / sd)
    assert out["c"]["zW"] == pytest.approx((4 - m) / sd)
    # normalised by the largest |z| of the season: c reaches 1
    assert out["c"]["nW"] == pytest.approx(1.0)


def test_negated_measure(spark):
    spec = SeasonSpec(raw=("t",), measures=(Measure("T", NEGATED, "t"),), carry=())
    df = _rows(spark, [("a", 1, 1.0), ("b", 1, 3.0)], ["name", "year", "t"])
    out = {r["name"]: r["zT"] for r in season_scores(df, spec).collect()}
    assert out["a"] == pytest.approx(1.0) and out["b"] == pytest.approx(-1.0)


def test_zero_deviation_gives_null(spark):
    df = _rows(spark, [("a", 1, 5.0), ("b", 1, 5.0), ("a", 2, 1.0), ("b", 2, 2.0)],
               ["name", "year", "x"])
    out = {(r["name"], r["year"]): r for r in season_scores(df, ONE).collect()}
    assert out[("a", 1)]["zX"] is None and out[("a", 1)]["zTOT"] is None
    assert out[("a", 2)]["zX"] == pytest.approx(-1.0)


def test_invariants_on_customer_seasons(spark):
    from tests.conftest import SF_SMALL
    from stintwise.plans import season_tables as st
    from stintwise.spec import CUSTOMER as C

    p = st.players(spark, SF_SMALL, "customer")
    checks = []
    for z in C.z_cols:
        checks += [F.avg(z).alias(f"a_{z}"), F.stddev_pop(z).alias(f"s_{z}")]
    for n in C.n_cols:
        checks += [F.max(F.abs(n)).alias(f"m_{n}")]
    for r in p.groupBy("year").agg(*checks).collect():
        for z in C.z_cols:
            assert r[f"a_{z}"] == pytest.approx(0.0, abs=1e-9)
            assert r[f"s_{z}"] == pytest.approx(1.0, abs=1e-9)
        for n in C.n_cols:
            assert r[f"m_{n}"] == pytest.approx(1.0, abs=1e-12)
