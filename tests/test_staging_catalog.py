"""Incremental staging of season files, and the catalog tables."""

import os

from stintwise.spec import CSV_FIELDS
from stintwise.streaming.staging import stage_new_season_files
from tests.conftest import SF_SMALL


def _season_file(d, year, names):
    lines = ["", ",".join(CSV_FIELDS)]
    for i, n in enumerate(names, 1):
        lines.append(",".join([str(i), n, "G", "25", "AAA", "10", "", "20.0"] + ["1.0"] * 22))
    (d / f"league_stats_{year}_per_game.csv").write_text("\n".join(lines) + "\n")


def test_stage_only_new_files(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    target, ckpt = str(tmp_path / "staged"), str(tmp_path / "ckpt")
    _season_file(src, 1980, ["A", "B*"])
    stage_new_season_files(spark, str(src / "*.csv"), target, ckpt)
    assert spark.read.parquet(target).count() == 2
    stage_new_season_files(spark, str(src / "*.csv"), target, ckpt)   # nothing new
    assert spark.read.parquet(target).count() == 2
    _season_file(src, 1981, ["A", "C", "D"])
    stage_new_season_files(spark, str(src / "*.csv"), target, ckpt)
    df = spark.read.parquet(target)
    assert df.count() == 5
    assert {r["year"]: r["count"] for r in df.groupBy("year").count().collect()} == {1980: 2, 1981: 3}
    assert {r["name"] for r in df.collect()} == {"A", "B", "C", "D"}


def test_write_all_and_drop(spark):
    from stintwise.plans.season_tables import write_all
    from stintwise.sources.catalog import drop_outputs

    targets = spark.read.parquet(f"{SF_SMALL}/orders.parquet").selectExpr(
        "o_custkey AS name").distinct().orderBy("name").limit(2)
    saved = write_all(spark, SF_SMALL, "seasons_test", kind="customer", similar_targets=targets)
    assert saved == ["players", "age", "experience", "ml", "similar"]
    sim = spark.table("seasons_test.similar")
    assert sim.columns == ["experience", "year", "name", "similar_player", "similarity_score"]
    assert sim.select("name").distinct().count() <= 2
    p = spark.table("seasons_test.players")
    assert p.columns[0] == "exp" and p.count() > 0
    assert spark.table("seasons_test.age").count() > 0
    assert spark.table("seasons_test.ml").count() > 0
    # every season is one row per entity
    assert p.groupBy("name", "year").count().filter("count > 1").count() == 0
    drop_outputs(spark, "seasons_test")
    assert not spark.catalog.tableExists("seasons_test.players")


def test_write_if_absent_keeps_existing_table(spark):
    from stintwise.sources.catalog import create_database, drop_outputs, write_table

    create_database(spark, "seasons_ignore")
    write_table(spark.range(3), "seasons_ignore.ml")
    write_table(spark.range(10), "seasons_ignore.ml", mode="ignore")   # CREATE TABLE IF NOT EXISTS
    assert spark.table("seasons_ignore.ml").count() == 3
    write_table(spark.range(10), "seasons_ignore.ml")                  # default: overwrite
    assert spark.table("seasons_ignore.ml").count() == 10
    drop_outputs(spark, "seasons_ignore")
