"""NULL clubs, blank ranks, undefined scores, missing features, early `last`, stray file names."""

from pyspark.sql import functions as F

from stintwise.operators.career import next_season_roster
from stintwise.operators.clean import clean_lines, dedupe_prefer_total
from stintwise.operators.predict import combine_predictions, fit_next_season
from stintwise.operators.similar import career_similarity, most_similar_topk
from stintwise.sources.csv import read_season_csv
from stintwise.spec import BASKETBALL, PLAIN, Measure, SeasonSpec


def test_total_row_beats_null_club(spark):
    df = spark.createDataFrame([("x", 1, None, 10, 1), ("x", 1, "TOT", 80, 2), ("y", 1, None, 5, 1), ("y", 1, "A", 5, None)],
                               "name string, year int, team string, gp int, Rk int")
    got = {r["name"]: r["team"] for r in dedupe_prefer_total(df, BASKETBALL).collect()}
    assert got == {"x": "TOT", "y": "A"}


def test_player_line_with_blank_rank_stays(spark):
    df = spark.createDataFrame([(None, "Al*"), ("Rk", "Player"), (None, None), ("3", "Bo")], "Rk string, Player string")
    assert sorted(r["Player"] for r in clean_lines(df).collect()) == ["Al", "Bo"]


def test_undefined_season_is_never_closer(spark):
    spec = SeasonSpec(measures=(Measure("s0", PLAIN, "s0"), Measure("s1", PLAIN, "s1")))
    rows = [("a", 1, 0.0, 0.0), ("a", 2, 0.0, 0.0), ("b", 1, None, 9.0), ("b", 2, 0.0, 0.0),
            ("c", 1, 0.1, 0.1), ("c", 2, 0.1, 0.1)]
    sim = career_similarity(spark.createDataFrame(rows, "name string, year bigint, zs0 double, zs1 double"), spec, ["a"])
    got = {(r["similar_player"], r["experience"]): r["similarity_score"] for r in sim.collect()}
    assert got[("b", 0)] is None and got[("b", 1)] is None
    assert abs(got[("c", 1)] - 0.1) < 1e-12
    top = most_similar_topk(sim, 1).collect()
    assert {r["similar_player"] for r in top} == {"c"}


def test_real_season_is_not_replaced_by_a_placeholder(spark):
    spec = SeasonSpec()
    df = spark.createDataFrame([("a", 2001, 20, 0, 1.0), ("a", 2002, 21, 1, 2.0), ("b", 2001, 30, 0, 3.0)],
                               "name string, year int, age int, exp int, zTOT double")
    got = sorted((r["name"], r["year"], r["zTOT"]) for r in next_season_roster(df, spec, 2001).collect()
                 if r["year"] == 2002)
    assert got == [("a", 2002, 2.0), ("b", 2002, None)]


def test_every_test_row_keeps_a_place(spark):
    train = spark.createDataFrame([(f"p{i}", 2000, i % 7, float(i), 2.0 * i) for i in range(60)]
                                  + [("n", 2000, None, 1.0, 1.0)], "name string, year int, exp int, zx0 double, label double")
    test = spark.createDataFrame([("a", 2001, 3, 5.0, None), ("b", 2001, 3, None, 1.0)],
                                 "name string, year int, exp int, zx0 double, label double")
    pred, _ = fit_next_season(train, test, "zX")
    got = {r["name"]: r["prediction"] for r in combine_predictions({"zX": pred, "zY": pred}).collect()}
    assert set(got) == {"a", "b"} and got["a"] is not None and got["b"] is None


def test_stray_file_name_has_no_year(spark, tmp_path):
    (tmp_path / "league_stats_2001_x.csv").write_text("1,Al,G\n")
    (tmp_path / "notes.csv").write_text("1,Bo,G\n")
    got = {r["Player"]: r["year"] for r in read_season_csv(spark, str(tmp_path)).select("Player", "year").collect()}
    assert got == {"Al": 2001, "Bo": None}
    assert read_season_csv(spark, str(tmp_path)).where(F.col("year").isNull()).count() == 1


def test_local_copy_has_no_cap(spark, tmp_path):
    import pyarrow.parquet as pq

    from stintwise.operators.explore import local_batches, save_local

    df = spark.range(250_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('n', id) END AS name")
    sizes = [b.num_rows for b in local_batches(df)]
    assert sum(sizes) == 250_000 and len(sizes) > 8
    path = str(tmp_path / "all.parquet")
    assert save_local(df, path) == 250_000
    got = pq.read_table(path)
    assert got.num_rows == 250_000 and got["name"].null_count == 83_334
    assert save_local(df.limit(0), path) == 0 and pq.read_table(path).column_names == ["id", "name"]


def test_entry_works_without_the_optional_subpackage(tmp_path):
    """A dependency of the optional operators that cannot be imported costs
    those queries only."""
    import subprocess
    import sys

    from tests.conftest import ROOT

    (tmp_path / "ahocorasick.py").write_text("raise ImportError('not here')")
    code = ("import sys; sys.path[:0] = %r; import __spark_entry__ as E; q = E.queries(); "
            "print('season_scores' in q, [k for k in q if k.startswith('op')], set(E.oracle_sql()) == set(q))"
            % [str(tmp_path), ROOT])
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(tmp_path), timeout=120)
    assert out.stdout.strip() == "True [] True", out.stderr[-500:]
