"""Season files by listing: pick files before the scan, stage what changed.

A season's files are found by a listing alone (names, sizes, times; nothing is
opened), so a question about one season reads that season's files. Staging
keeps a manifest of the files behind every staged season. A later run compares
the listing with it and rewrites only the seasons whose files differ, each in
its own partition; the others' files are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .csv import YEAR_PATTERN, parse_seasons, read_season_csv, year_of_path

MANIFEST = "file string, modified timestamp, bytes long, year int"


def list_season_files(spark: SparkSession, path: str, first: int | None = None, last: int | None = None,
                      pattern: str = "*.csv", year_pattern: str = YEAR_PATTERN) -> DataFrame:
    """(file, modified, bytes, year) of the files under ``path``; ``first`` and
    ``last`` keep the seasons between them. A file without a season in its path
    has a NULL year."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", pattern).load(path))
    files = listed.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"),
                          F.col("length").alias("bytes"), year_of_path(F.col("path"), year_pattern).alias("year"))
    if first is not None:
        files = files.where(F.col("year") >= first)
    if last is not None:
        files = files.where(F.col("year") <= last)
    return files


def read_seasons(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The text lines of the seasons asked for, reading their files only."""
    files = [r["file"] for r in list_season_files(spark, path, first, last).select("file").collect()]   # a listing
    if not files:
        return read_season_csv(spark, path).where(F.lit(False))
    return read_season_csv(spark, files)


def read_manifest(spark: SparkSession, target: str) -> DataFrame:
    """What is staged under ``target``; empty before the first run."""
    fs, path = _folder(spark, f"{target}.manifest")
    if not fs.exists(path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{target}.manifest")


def changed_seasons(listing: DataFrame, manifest: DataFrame) -> list[int]:
    """Seasons with a file that is new, gone, or of another size or time."""
    a, b = (df.select("year", "file", "modified", "bytes").where("year IS NOT NULL") for df in (listing, manifest))
    either = a.exceptAll(b).select("year").union(b.exceptAll(a).select("year")).distinct()
    return sorted(r["year"] for r in either.collect())          # one row a season


def stage_changed(spark: SparkSession, source: str, target: str) -> list[int]:
    """Bring the parsed lines staged under ``target`` (a folder per year) up to
    date with the season files under ``source``; returns the seasons rewritten.

    Only those seasons are read and written. The manifest is written last: a
    run that dies before it stages the same seasons again.
    """
    found = list_season_files(spark, source).where("year IS NOT NULL").collect()     # a listing, taken once
    listing = spark.createDataFrame(found, MANIFEST)
    manifest = read_manifest(spark, target)
    years = changed_seasons(listing, manifest)
    if not years:
        return []
    files = [r["file"] for r in listing.where(F.col("year").isin(years)).select("file").collect()]
    if files:
        lines = parse_seasons(read_season_csv(spark, files))
        _write_seasons(lines, target)
    here = {r["year"] for r in listing.select("year").distinct().collect()}
    for year in set(years) - here:                              # its files are gone
        for folder in (target, f"{target}.manifest"):
            fs, path = _folder(spark, f"{folder}/year={year}")
            fs.delete(path, True)
    _write_seasons(listing.where(F.col("year").isin(years)), f"{target}.manifest")
    return years


def _folder(spark: SparkSession, name: str):
    """(file system, path) of a folder in any store Spark can write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _write_seasons(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path))
