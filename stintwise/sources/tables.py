"""Season records derived from the test tables.

The test tables hold no players, so two stand-ins are built (roles in

* customer seasons: entity ``o_custkey``, period the order year, club the
  order priority;
* supplier seasons: entity ``l_suppkey``, period the ship year, club the
  return flag.

One row per (entity, period, club), plus a ``TOT`` row summed over all clubs
where an entity has two or more clubs in a period, like the season-total
row of the reference's CSV files.

Plan: line items are first reduced to one row per order (customers) or per
(supplier, year, flag, order) (suppliers) with partial aggregation, so the
shuffles carry sums, not lines. Club rows are a second aggregation, and
``TOT`` rows a third one over the club rows only (at most one row per club).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# Age of an entity in a period is year - BIRTH_BASE - entity % AGE_SPREAD.
BIRTH_BASE = 1960
AGE_SPREAD = 20

# Sums kept per (entity, period, club); measures are ratios of them.
_SUMS = ("n_lines", "n_r", "n_o", "s_qty", "s_price", "s_tax", "s_net", "s_disc")


CATALOG_PREFIX = "catalog:"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table: ``<sf_dir>/<name>.parquet``, or the catalog table
    ``<db>.<name>`` when ``sf_dir`` is ``catalog:<db>`` (e.g. the bucketed
    copies written by ``bucket_by_order``)."""
    if sf_dir.startswith(CATALOG_PREFIX):
        return spark.table(f"{sf_dir[len(CATALOG_PREFIX):]}.{name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_by_order(spark: SparkSession, sf_dir: str, db: str, buckets: int = 64) -> str:
    """Write ``lineitem`` and ``orders`` as tables of ``db`` bucketed (and
    sorted) by order key, with the same bucket count.

    The per-order aggregate of line items and its join with orders then read
    co-partitioned buckets: neither table is shuffled by order key, the
    largest shuffle of the season-record build at scale. Returns the source
    string for ``load`` / ``season_records`` (``catalog:<db>``). Pick the
    bucket count so a bucket is a few hundred MB.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`")
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        (load(spark, sf_dir, name).write.mode("overwrite")
         .bucketBy(buckets, key).sortBy(key).saveAsTable(f"{db}.{name}"))
    return CATALOG_PREFIX + db


def _cents(c: str) -> Column:
    """A two-decimal money value as a whole number of cents (a double)."""
    return F.rint(F.col(c) * 100)


def _line_sums() -> list[Column]:
    """Per-group sums of line values. Money is summed in whole cents (TPC-H
    money is decimal(15,2)): sums of integer-valued doubles are exact while a
    group's sum stays below 2^53 (90 trillion in cents; ``s_net``, in cents times
    percents, 0.9 trillion), so up to there the result does not depend on
    summation order (and thus on partitioning). Beyond, the last bits do."""
    return [
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_r"),
        F.sum(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("n_o"),
        F.sum("l_quantity").alias("s_qty"),
        F.sum(_cents("l_extendedprice")).alias("s_price"),
        F.sum(_cents("l_tax")).alias("s_tax"),
        F.sum(_cents("l_extendedprice") * (100 - _cents("l_discount"))).alias("s_net"),
        F.sum(_cents("l_discount")).alias("s_disc"),
    ]


def _with_tot(club_rows: DataFrame, extra_sums: tuple[str, ...]) -> DataFrame:
    """Add a TOT row per (name, year) with two or more clubs."""
    sums = ("gp",) + _SUMS + extra_sums
    tot = (
        club_rows.groupBy("name", "year")
        .agg(F.count(F.lit(1)).alias("n_clubs"), *[F.sum(c).alias(c) for c in sums])
        .filter(F.col("n_clubs") >= 2)
        .select("name", "year", F.lit("TOT").alias("team"), *sums)
    )
    return club_rows.select("name", "year", "team", *sums).unionByName(tot)


def _measures(rows: DataFrame, with_total: bool) -> DataFrame:
    lines = F.col("n_lines").cast("double")
    gp = F.col("gp").cast("double")
    cols = [
        F.col("name").cast("bigint").alias("name"),
        F.col("year").cast("bigint").alias("year"),
        F.col("team"),
        (F.col("year") - BIRTH_BASE - F.col("name") % AGE_SPREAD).cast("bigint").alias("age"),
        F.col("gp").cast("bigint").alias("gp"),
        (F.col("n_r") / lines).alias("pct1"),
        (lines / gp).alias("att1"),
        (F.col("n_o") / lines).alias("pct2"),
        (F.col("s_qty") / gp).alias("att2"),
        (F.col("s_qty") / lines).alias("m1"),
        (F.col("s_price") / (lines * 100)).alias("m2"),
        (F.col("s_tax") / (lines * 100)).alias("m3"),
        (lines / gp).alias("m4"),
        (F.col("s_net") / (lines * 10000)).alias("m5"),
    ]
    if with_total:
        cols.append((F.col("s_total") / (gp * 100)).alias("m6"))
    cols.append((F.col("s_disc") / (lines * 100)).alias("neg1"))
    return rows.select(*cols)


def customer_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer seasons: one row per (o_custkey, order year, priority) + TOT."""
    lineitem = load(spark, sf_dir, "lineitem")
    orders = load(spark, sf_dir, "orders")
    per_order = lineitem.groupBy("l_orderkey").agg(*_line_sums())
    joined = orders.select(
        "o_orderkey", "o_custkey", "o_totalprice",
        F.year("o_orderdate").alias("year"), "o_orderpriority",
    ).join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    club = joined.groupBy(
        F.col("o_custkey").alias("name"), "year", F.col("o_orderpriority").alias("team")
    ).agg(
        F.count(F.lit(1)).alias("gp"),
        *[F.sum(c).alias(c) for c in _SUMS],
        F.sum(_cents("o_totalprice")).alias("s_total"),
    )
    return _measures(_with_tot(club, ("s_total",)), with_total=True)


def supplier_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier seasons: one row per (l_suppkey, ship year, return flag) + TOT."""
    lineitem = load(spark, sf_dir, "lineitem")
    per_order = lineitem.groupBy(
        F.col("l_suppkey").alias("name"), F.year("l_shipdate").alias("year"),
        F.col("l_returnflag").alias("team"), "l_orderkey",
    ).agg(*_line_sums())
    club = per_order.groupBy("name", "year", "team").agg(
        F.count(F.lit(1)).alias("gp"), *[F.sum(c).alias(c) for c in _SUMS]
    )
    return _measures(_with_tot(club, ()), with_total=False)


def season_records(spark: SparkSession, sf_dir: str, kind: str = "customer") -> DataFrame:
    if kind == "customer":
        return customer_seasons(spark, sf_dir)
    if kind == "supplier":
        return supplier_seasons(spark, sf_dir)
    raise ValueError(f"unknown season kind {kind!r}")
