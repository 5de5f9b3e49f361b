"""Connected components of a link table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _total(labels: DataFrame):
    return labels.agg(F.count("*"), F.sum(F.col("component").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in ``edges``: the smallest id reachable.

    Minimum labels move along the links and then jump to their own label's
    label, so the rounds grow with the logarithm of the longest path. Each
    round's labels are a written table; a node with many links is an ordinary
    (splittable) join key with a map-side minimum, never one group. Links with
    a null end and links of an id with itself join nothing.
    """
    one = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    both = written(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "links")
    labels = written(both.groupBy(F.col("src").alias("id")).agg(F.least("id", F.min("dst")).alias("component")), "labels")
    total = _total(labels)
    while True:
        seen = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(
            F.min("component").alias("near"))
        low = labels.join(seen, "id").select("id", F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = low.join(jump, "component").select("id", F.least("component", "further").alias("component"))
        new = written(new, "labels")
        now = _total(new)
        drop_written(labels)
        labels = new
        if now == total:
            drop_written(both)
            return labels
        total = now
