"""Merged season states against a recompute over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from stintwise.operators import moments

SCHEMA = "name string, year int, a double, b double"


def rows(n=400, seed=1):
    rnd = random.Random(seed)
    dirty = lambda v: rnd.choice([v] * 8 + [None, float("nan")])
    return ([(f"e{i}", 2000 + i % 4, dirty(1e9 + rnd.gauss(0, 1)), dirty(rnd.gauss(0, 3))) for i in range(n)]
            + [("x", 2005, None, float("nan")), ("y", None, 1.0, 2.0)])


def recomputed(df, keys):
    out = {}
    for m in ("a", "b"):
        c = F.when(~F.isnan(m), F.col(m))
        for r in df.groupBy(*keys).agg(F.count(c), F.avg(c), F.stddev_pop(c), F.max(c), F.min(c), F.count_if(c.isNull())).collect():
            out[(*r[:len(keys)], m)] = r[len(keys):]
    return out


def same(got, want, keys):
    got = {(*[r[k] for k in keys], r["stat"]): r[len(keys) + 1:] for r in got.collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        for x, y in zip(got[k], w):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9, abs=1e-6))


def test_new_season_equals_recompute(spark, tmp_path):
    path, df = str(tmp_path / "state"), spark.createDataFrame(rows(), SCHEMA)
    old, new = df.where("year IS NULL OR year <> 2003"), df.where("year = 2003")
    moments.add_load(moments.partial_state(old, ["year"], ["a", "b"]), path, "until-2002")
    moments.add_load(moments.partial_state(new, ["year"], ["a", "b"]), path, "2003")
    kept = moments.read_loads(spark, path)
    same(moments.finished(moments.merged(kept, ["year"]), ["year"]), recomputed(df, ["year"]), ["year"])
    same(moments.finished(moments.merged(kept, []), []), recomputed(df, []), [])


def test_parts_of_a_season_and_a_repeated_load(spark, tmp_path):
    path, df = str(tmp_path / "state"), spark.createDataFrame(rows(), SCHEMA)
    for i in (0, 1, 2, 1):                                   # load 1 runs twice
        part = df.where(F.pmod(F.xxhash64("name"), F.lit(3)) == i)
        moments.add_load(moments.partial_state(part, ["year"], ["a", "b"]), path, f"part-{i}")
    moments.add_load(moments.partial_state(df.limit(0), ["year"], ["a", "b"]), path, "empty")
    kept = moments.read_loads(spark, path)
    same(moments.finished(moments.merged(kept, ["year"]), ["year"]), recomputed(df, ["year"]), ["year"])


def test_refresh_reads_one_season(spark, tmp_path):
    table = str(tmp_path / "seasons")
    spark.createDataFrame(rows(), SCHEMA).write.partitionBy("year").parquet(table)
    one = moments.partial_state(spark.read.parquet(table).where("year = 2003"), ["year"], ["a"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "(year#" in plan
    assert {f.split("year=")[1][:4] for f in spark.read.parquet(table).where("year = 2003").inputFiles()} >= {"2003"}
    scanned = one._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert "2003" in scanned.toString()
