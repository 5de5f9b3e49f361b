"""Rejects, staging of changed seasons, file pruning, and the swap of a saved table."""

import os
import time

import pytest
from pyspark.sql import functions as F

from stintwise.sources import catalog
from stintwise.sources.csv import (BLANK, HEADER, MALFORMED, NO_NAME, NO_SEASON, counted, kept_and_rejected,
                                   read_season_lines, read_staged)
from stintwise.sources.seasons import changed_seasons, list_season_files, read_manifest, read_seasons, stage_changed
from stintwise.spec import CSV_FIELDS


def line(rk, name, games=10):
    return ",".join([str(rk), name, "G", "25", "AAA", str(games), "", "20.0"] + ["1.0"] * 22)


def season(folder, year, lines):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"league_{year}_per_game.csv")
    with open(path, "w") as f:
        f.write("\n".join(["", ",".join(CSV_FIELDS), *lines]) + "\n")
    return path


def test_every_line_is_kept_or_rejected(spark, tmp_path):
    src = str(tmp_path / "src")
    season(src, 1980, [line(1, "A"), line(2, ""), line(3, "B*"), "4,C,G", line(5, "D") + ",31", "," * 29, ",".join(CSV_FIELDS)])
    season(src, 1981, [line(1, "A"), line("", "No Rank")])
    season(src, "notes", [line(9, "Stray")])
    lines, seen = counted(read_season_lines(spark, src))
    path = str(tmp_path / "lines")
    lines.write.parquet(path)
    counts = seen.get                                              # of the same pass
    kept, rejects = kept_and_rejected(spark.read.parquet(path))
    by = {}
    for r in rejects.collect():
        by[r["reason"]] = by.get(r["reason"], 0) + 1
    assert by == {MALFORMED: 2, HEADER: 4, BLANK: 1, NO_NAME: 1, NO_SEASON: 1}
    assert counts == {"lines": 13, "kept": 4, **by} and kept.count() == 4
    assert sorted((r["year"], r["name"], r["Rk"]) for r in kept.collect()) == [
        (1980, "A", 1), (1980, "B", 3), (1981, "A", 1), (1981, "No Rank", 0)]
    assert {r["line"] for r in rejects.where(F.col("reason") == MALFORMED).collect()} == {"4,C,G", line(5, "D") + ",31"}


def staged_files(target):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(target) for f in names if f.endswith(".parquet")}


def test_only_changed_seasons_are_staged_again(spark, tmp_path):
    src, target = str(tmp_path / "src"), str(tmp_path / "staged")
    for y in (1980, 1981, 1982):
        season(src, y, [line(1, "A"), line(2, f"P{y}")])
    season(src, "notes", [line(1, "Stray")])
    assert stage_changed(spark, src, target) == [1980, 1981, 1982]
    before = staged_files(target)
    assert stage_changed(spark, src, target) == [] and staged_files(target) == before
    time.sleep(0.01)
    season(src, 1981, [line(1, "A"), line(2, "New"), line(3, "Newer")])
    os.remove(os.path.join(src, "league_1982_per_game.csv"))
    season(src, 1983, [line(1, "A")])
    assert stage_changed(spark, src, target) == [1981, 1982, 1983]
    after = staged_files(target)
    assert {f: t for f, t in before.items() if "year=1980" in f} == {f: t for f, t in after.items() if "year=1980" in f}
    got = {(r["year"], r["name"]) for r in read_staged(spark, target).collect()}
    assert got == {(1980, "A"), (1980, "P1980"), (1981, "A"), (1981, "New"), (1981, "Newer"), (1983, "A")}
    assert {r["year"] for r in read_manifest(spark, target).collect()} == {1980, 1981, 1983}
    listing = list_season_files(spark, src).where("year IS NOT NULL")
    assert changed_seasons(listing, read_manifest(spark, target)) == []


def test_one_season_reads_its_files_only(spark, tmp_path):
    src = str(tmp_path / "src")
    paths = [season(src, y, [line(1, f"P{y}")]) for y in range(1980, 1990)]
    one = read_seasons(spark, src, 1985, 1986)
    assert sorted(os.path.basename(f) for f in one.inputFiles()) == [os.path.basename(p) for p in paths[5:7]]
    assert {r["Player"] for r in one.where("Rk = '1'").collect()} == {"P1985", "P1986"}
    assert read_seasons(spark, src, 2050).count() == 0


def test_a_failed_save_leaves_the_old_table(spark):
    catalog.create_database(spark, "swap_test")
    name = "swap_test.players"
    catalog.drop_outputs(spark, "swap_test")
    assert catalog.save_and_swap(spark.range(3), name) == 3
    assert catalog.save_and_swap(spark.range(5), name, verify=lambda t: t.count() == 5, partition_by=None) == 5
    broken = spark.range(100).select(F.raise_error(F.lit("half way")).cast("long").alias("id"))
    for df, check, error in ((broken, None, Exception), (spark.range(9), lambda t: False, ValueError)):
        with pytest.raises(error):
            catalog.save_and_swap(df, name, verify=check)
        assert spark.table(name).count() == 5
    assert {t.name for t in spark.catalog.listTables("swap_test")} == {"players"}
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}__old")           # died between the renames
    catalog.recover(spark, name)
    assert spark.table(name).count() == 5
    assert catalog.save_and_swap(spark.range(2), name) == 2
    for n in (6, 9):                                                # partitions move with the table
        parts = spark.range(n).withColumn("year", F.concat(F.lit("a b/"), F.col("id") % 3))
        assert catalog.save_and_swap(parts, name, partition_by=["year"]) == n and spark.table(name).count() == n
        assert spark.table(name).where("year = 'a b/1'").count() == n // 3
    catalog.drop_outputs(spark, "swap_test")


def test_scope_releases_caches_and_folders(spark):
    from stintwise.plans.scope import owned
    from stintwise.plans.sizing import checked_broadcast, cut_lineage

    with owned(spark) as outer:
        with pytest.raises(RuntimeError), owned(spark) as own:
            kept, small = checked_broadcast(spark.range(10).withColumn("text", F.lit("x" * 100)))
            table = cut_lineage(spark.range(5), "scoped")
            assert small and kept.count() == 10 and table.count() == 5 and len(own.frames) == len(own.paths) == 1
            folder = own.paths[0].removeprefix("file:")
            assert os.path.isdir(folder)
            raise RuntimeError("the work failed")
        assert not os.path.exists(folder) and not own.frames and not own.paths and not outer.frames
    assert not kept.storageLevel.useMemory and not kept.storageLevel.useDisk
    wide = spark.range(10).withColumn("text", F.lit("x" * 100))
    with owned(spark):
        assert checked_broadcast(wide, max_bytes=900)[1] is False        # strings are measured, not taken as 8 bytes


def test_few_keys_beyond_the_limit_are_salted(spark):
    from stintwise.plans.sizing import join_few_keys

    big = spark.range(1000).select((F.col("id") % 3).alias("year"), F.col("id").alias("name")).union(
        spark.createDataFrame([(None, 1000)], "year long, name long"))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (None, "d")], "year long, v string")
    rows = {tuple(r) for r in join_few_keys(big, small, "year", "name", True).collect()}
    salted = join_few_keys(big, small, "year", "name", False, salts=4).hint("shuffle_hash")
    assert {tuple(r) for r in salted.collect()} == rows and len(rows) == 1001
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = join_few_keys(big, small, "year", "name", False, salts=4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert len(keys) == 2 and all("_salt" in k or "_copy" in k for k in keys)
