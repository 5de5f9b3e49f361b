"""Career operators on hand-worked rows (FIXTURES.md section 8)."""

import pytest

from stintwise.operators.career import (exclude_first_season, experience, next_season_roster,
                                        prior_season_features, season_delta, season_index)
from stintwise.spec import SeasonSpec

SPEC = SeasonSpec(carry=("team", "gp"))


def _players(spark):
    # one entity in years 1, 2, 4; another in 2 and 4
    rows = [
        ("a", 1, 20, "X", 10, 1.0, 0.5, 0.1),
        ("a", 2, 21, "X", 10, 3.0, 0.7, 0.2),
        ("a", 4, 23, "X", 10, 2.0, 0.1, 0.3),
        ("b", 2, 30, "Y", 10, 5.0, 0.9, 0.4),
        ("b", 4, 32, "Y", 10, 4.0, 0.8, 0.5),
    ]
    df = spark.createDataFrame(rows, "name string, year bigint, age bigint, team string, gp bigint,"
                                     " zTOT double, nTOT double, zX double")
    return experience(df, SPEC)


def test_experience_and_index(spark):
    p = _players(spark)
    exp = {(r["name"], r["year"]): r["exp"] for r in p.collect()}
    assert exp[("a", 1)] == 0 and exp[("a", 4)] == 3 and exp[("b", 4)] == 2
    idx = {(r["name"], r["year"]): r["season_index"] for r in season_index(p, SPEC).collect()}
    assert [idx[("a", y)] for y in (1, 2, 4)] == [0, 1, 2]


def test_delta_to_previous_observed_season(spark):
    d = {(r["name"], r["year"]): r for r in season_delta(_players(spark), SPEC).collect()}
    assert d[("a", 1)]["deltaZ"] is None
    assert d[("a", 2)]["deltaZ"] == pytest.approx(2.0)
    assert d[("a", 4)]["deltaZ"] == pytest.approx(-1.0)   # gap: previous observed is 2
    assert d[("a", 4)]["deltaN"] == pytest.approx(-0.6)


def test_prior_season_features_exact_previous_year(spark):
    spec = SeasonSpec(carry=("team", "gp"), measures=())
    p = _players(spark)
    ml = {(r["name"], r["year"]): r for r in prior_season_features(p, spec, last=4).collect()}
    # a: only year 2 has year 1 before it; year 5 placeholder has 4 before it
    assert set(ml) == {("a", 2), ("a", 5), ("b", 5)}
    assert ml[("a", 2)]["ztot0"] == pytest.approx(1.0)
    assert ml[("a", 2)]["ztotdiff"] == pytest.approx(2.0)
    ph = ml[("a", 5)]
    assert ph["ztot"] is None and ph["ztotdiff"] == 0.0 and ph["ztot0"] == pytest.approx(2.0)
    assert ph["exp"] == 4 and ph["age"] == 24 and ph["team"] is None


def test_roster_adds_one_placeholder_per_active_entity(spark):
    r = next_season_roster(_players(spark), SPEC, last=4)
    assert r.count() == 5 + 2
    assert r.filter("year = 5").count() == 2


def test_exclude_first_season(spark):
    out = exclude_first_season(_players(spark), SPEC, 1)
    assert {r["name"] for r in out.collect()} == {"b"}
