"""Stored partial summaries that merge: adding a season rescans no other.

The state of a key and measure is its count, mean, sum of squared deviations,
greatest and least value and number of missing values. States of disjoint rows
merge into the state of all of them, so a summary per season, per club or of all
time is kept as one small table, one folder per load, and a new season adds its
own folder:

    add_load(season_state(rows_of_2018, spec), path, "2018")
    finished(merged(read_loads(spark, path), ["year"]), ["year"])     # per season
    finished(merged(read_loads(spark, path), []), [])                 # all time

Loading the same load id again replaces that load (dynamic partition
overwrite), so a job that ran twice counts nothing twice. NaN and NULL are missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null
from ..spec import SeasonSpec

LOAD = "load"


def partial_state(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """(keys, stat, n, mean, m2, hi, lo, missing), one row per key and measure:
    partial aggregation before the shuffle, one row per key after it."""
    def state(m: str):
        c = nan_to_null(F.col(f"`{m}`").cast("double"))
        n = F.count(c)
        return F.struct(F.lit(m).alias("stat"), n.alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * n).alias("m2"),
                        F.max(c).alias("hi"), F.min(c).alias("lo"), F.count_if(c.isNull()).alias("missing"))

    wide = df.groupBy(*keys).agg(F.array(*[state(m) for m in measures]).alias("states"))
    return wide.select(*keys, F.explode("states").alias("s")).select(*keys, "s.*")


def season_state(df: DataFrame, spec: SeasonSpec) -> DataFrame:
    """The state of every raw measure per period."""
    return partial_state(df, [spec.period], list(spec.raw))


def merged(states: DataFrame, keys: list[str]) -> DataFrame:
    """States with the same keys and stat as one. Deviations are taken from the
    merged mean, not as a difference of squares."""
    by = Window.partitionBy(*keys, "stat")
    total = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(by), F.sum("n").over(by))
    apart = F.col("mean") - F.col("_total")
    return (states.withColumn("_total", total).groupBy(*keys, "stat").agg(
        F.sum("n").alias("n"), F.any_value("_total", ignoreNulls=True).alias("mean"),
        F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"),
        F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.sum("missing").alias("missing")))


def finished(states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, stat, count, avg, stdev, max, min, missing) of merged states."""
    return states.select(
        *keys, "stat", F.col("n").cast("double").alias("count"), F.col("mean").alias("avg"),
        F.sqrt(F.try_divide(F.col("m2"), F.col("n"))).alias("stdev"), F.col("hi").alias("max"), F.col("lo").alias("min"),
        F.col("missing").cast("double").alias("missing"))


def add_load(states: DataFrame, path: str, load: str) -> None:
    """Store the state of one load, replacing what an earlier run stored under
    the same id and touching no other load."""
    (states.withColumn(LOAD, F.lit(load)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(LOAD).parquet(path))


def read_loads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)
