"""Mergeable summaries: count, mean, population stdev, max, min (+ missing).

All are built-in aggregates, so Spark runs them as partial (map-side) plus
final aggregation: a hot group key costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY_AGGS = ("count", "avg", "stdev", "max", "min")
PROFILE_AGGS = ("count", "mean", "stdev", "max", "min")


def _stats(col: str, names: tuple[str, ...], missing: bool) -> list[Column]:
    c = F.col(f"`{col}`")
    out = [
        F.count(c).cast("double").alias(f"{col}_{names[0]}"),
        F.avg(c).alias(f"{col}_{names[1]}"),
        F.stddev_pop(c).alias(f"{col}_{names[2]}"),
        F.max(c).cast("double").alias(f"{col}_{names[3]}"),
        F.min(c).cast("double").alias(f"{col}_{names[4]}"),
    ]
    if missing:
        out.append(F.count_if(c.isNull()).cast("double").alias(f"{col}_missing"))
    return out


def summary_stats(df: DataFrame, keys: list[str], measures: list[str],
                  names: tuple[str, ...] = SUMMARY_AGGS, missing: bool = False) -> DataFrame:
    """Per key: count (non-missing), mean, population stdev, max, min of each measure."""
    aggs = [a for m in measures for a in _stats(m, names, missing)]
    return df.groupBy(*keys).agg(*aggs)


def summary_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Wide summary -> long (key..., stat, agg, value) rows."""
    values = [c for c in wide.columns if c not in keys]
    long = wide.unpivot(keys, values, "key", "value")
    return long.select(
        *keys,
        F.regexp_extract("key", r"^(.*)_([a-z]+)$", 1).alias("stat"),
        F.regexp_extract("key", r"^(.*)_([a-z]+)$", 2).alias("agg"),
        "value",
    )


def profile(df: DataFrame, key: str, values: list[str], label: str | None = None) -> DataFrame:
    """Group by one key (age, experience) and summarise each value column.

    Count columns are DOUBLE, like the reference's age / experience tables.
    """
    out = summary_stats(df, [key], values, names=PROFILE_AGGS)
    if label and label != key:
        out = out.withColumnRenamed(key, label)
    return out
