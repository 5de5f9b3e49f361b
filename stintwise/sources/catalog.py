"""Catalog sinks: database, managed tables, clean-up."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# The result tables of the reference's database.
OUTPUT_TABLES = ("players", "age", "experience", "similar", "ml", "regression_total")


def create_database(spark: SparkSession, db: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`")


def write_table(df: DataFrame, name: str, mode: str = "overwrite",
                compression: str | None = None, partition_by: list[str] | None = None,
                repartition_by: list[str] | None = None) -> None:
    """Save as a managed table. ``mode="ignore"`` keeps an existing table
    (the reference's CREATE TABLE IF NOT EXISTS); the default overwrites.

    ``repartition_by`` hash-partitions by those columns before the write
    (few, large files per key range); otherwise AQE's partitioning is kept.
    """
    if repartition_by:
        df = df.repartition(*repartition_by)
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)


OLD = "__old"


def recover(spark: SparkSession, name: str) -> None:
    """Finish a swap that died between its two renames."""
    if spark.catalog.tableExists(name + OLD):
        if spark.catalog.tableExists(name):
            spark.sql(f"DROP TABLE {name}{OLD}")
        else:
            _rename(spark, name + OLD, name)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    """Rename a managed table. Spark's in-memory catalog moves a table's folder
    but not the locations of its partitions, so they are set here."""
    spark.sql(f"ALTER TABLE {old} RENAME TO {new}")
    if spark.conf.get("spark.sql.catalogImplementation") != "in-memory":
        return
    detail = spark.sql(f"DESCRIBE TABLE EXTENDED {new}")
    if detail.where("col_name = '# Partition Information'").isEmpty():
        return
    root = detail.where("col_name = 'Location'").first()["data_type"]
    for r in spark.sql(f"SHOW PARTITIONS {new}").collect():          # one row a season
        values = [p.split("=", 1) for p in r["partition"].split("/")]
        spec = ", ".join(f"`{k}` = '{unquote(v)}'" for k, v in values)
        spark.sql(f"ALTER TABLE {new} PARTITION ({spec}) SET LOCATION '{root}/{r['partition']}'")


def save_and_swap(df: DataFrame, name: str, verify: Callable[[DataFrame], bool] | None = None, **options) -> int:
    """Save ``df`` as the managed table ``name`` (db.table) without readers ever
    seeing half of it; returns the rows written.

    The rows go to a side table, which must hold as many rows as were written and
    satisfy ``verify``; only then it takes the name, by two renames. If the write
    or a check fails, the table that was there stays and the side table goes.
    ``options`` are those of :func:`write_table`.
    """
    spark = df.sparkSession
    recover(spark, name)
    side, written = f"{name}__{uuid.uuid4().hex[:8]}", Observation(f"rows of {name}")
    try:
        write_table(df.observe(written, F.count(F.lit(1)).alias("rows")), side, **options)
        saved, rows = spark.table(side), written.get["rows"]
        if saved.count() != rows:
            raise RuntimeError(f"{name}: {rows} rows were written, {saved.count()} can be read back")
        if verify is not None and not verify(saved):
            raise ValueError(f"{name}: the rows to save do not pass their check")
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {side}")
        raise
    if spark.catalog.tableExists(name):
        _rename(spark, name, name + OLD)
    _rename(spark, side, name)
    spark.sql(f"DROP TABLE IF EXISTS {name}{OLD}")
    return rows


def drop_outputs(spark: SparkSession, db: str, tables=OUTPUT_TABLES) -> None:
    for t in tables:
        spark.sql(f"DROP TABLE IF EXISTS `{db}`.`{t}`")


def register_views(tables: dict[str, DataFrame]) -> list[str]:
    """Session temp views, so the results can be queried with ``spark.sql``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return list(tables)
