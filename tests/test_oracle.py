"""Every registered query against its DuckDB oracle on the smallest tables
(row count, column names, order-insensitive value hash)."""

import pytest

import __spark_entry__ as E
from stintwise.plans import queries as base
from tools.oracle_check import TYPE_MAP, digest, duck
from tests.conftest import SF_SMALL

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    dtypes = {d[0]: str(d[1]) for d in res.description}
    assert {c: TYPE_MAP.get(t, t) for c, t in df.dtypes} == dtypes
    assert len(srows) == len(drows)
    assert digest(df.columns, srows) == digest(dcols, drows)


def test_every_query_has_an_oracle():
    assert set(ORACLE) <= set(QUERIES)
    assert set(base.spark_queries()) - set(base.oracle_sql()) == set()


def test_predictions_cover_next_season(spark):
    features = QUERIES["prior_season_features"](spark, SF_SMALL)
    names = sorted(r["name"] for r in features.filter(features.year == base.LAST + 1).collect())
    rows = QUERIES["combined_prediction"](spark, SF_SMALL).collect()
    assert names and sorted(r["name"] for r in rows) == names
    assert all(r["prediction"] is not None and r["label"] is None for r in rows)


def test_rmse_counts_every_labelled_row(spark):
    features = QUERIES["prior_season_features"](spark, SF_SMALL)
    labelled = features.filter((features.year == base.LAST) & features.zw1.isNotNull()).count()
    rows = QUERIES["prediction_rmse"](spark, SF_SMALL).collect()
    assert len(rows) == 1 and rows[0]["n"] == labelled > 0 and rows[0]["rmse"] >= 0


@pytest.mark.parametrize("name", ["experience", "season_index", "exclude_first_season", "mean_by_season"])
def test_unscored_queries_join_no_summary(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    # orders with their lines, once per branch of the TOT union (the exchange is reused)
    assert "stddev_pop" not in plan and plan.count("Join") == 2


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["name", "zTOT"]
    assert 0 < df.count() <= 25
