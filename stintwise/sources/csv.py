"""Per-season CSV files in the reference's layout.

One file per season, 30 comma-separated fields, the season year in the file
name (``..._<year>_...``), a blank first line and header lines repeated
through the file. One scan reads every year: the year comes from the file
path, so there is no per-year job and no text round trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import clean_lines, nan_to_null, typed_parse
from ..spec import CSV_FIELDS

CSV_SCHEMA = T.StructType([T.StructField(f, T.StringType(), True) for f in CSV_FIELDS])

# CSV field -> players-table column, where the name differs.
RENAME = {
    "Player": "name", "Pos": "position", "Age": "age", "Tm": "team", "G": "gp",
    "GS": "gs", "MP": "mp", "FG%": "FGP", "3P%": "3PP", "2P%": "2PP", "eFG%": "eFG",
    "FT%": "FTP",
}
INT_FIELDS = ("Rk", "Age", "G", "GS")
# the last "_<4 digits>_" of the path (folders above may hold digits too)
YEAR_PATTERN = r".*_(\d{4})_"


def year_of_path(path: Column, year_pattern: str = YEAR_PATTERN) -> Column:
    """The season that a file's path names, or NULL."""
    return F.regexp_extract(path, year_pattern, 1).try_cast("int")


def read_season_csv(spark: SparkSession, path: str | list[str], first: int | None = None,
                    last: int | None = None, year_pattern: str = YEAR_PATTERN) -> DataFrame:
    """All season files under ``path`` (a folder or glob), fields as text,
    plus ``year`` taken from each file's path: one scan for all years, no
    per-year job.

    ``first`` / ``last`` filter rows by that year; files are not pruned by
    it (``seasons.read_seasons`` lists and reads those seasons' files only). Stage the lines with
    ``stage_season_files`` to get a table partitioned by year, whose year
    filters do prune partitions.
    """
    df = (spark.read.schema(CSV_SCHEMA).option("header", "false")
          .option("mode", "PERMISSIVE").csv(path))
    df = df.withColumn("year", year_of_path(F.col("_metadata.file_path"), year_pattern))
    if first is not None:
        df = df.filter(F.col("year") >= first)
    if last is not None:
        df = df.filter(F.col("year") <= last)
    return df


BLANK, HEADER, MALFORMED = "blank line", "repeated header", "malformed line"
NO_SEASON, NO_NAME = "no season in path", "blank name"
REASONS = (MALFORMED, BLANK, HEADER, NO_SEASON, NO_NAME)


def read_season_lines(spark: SparkSession, path: str | list[str], year_pattern: str = YEAR_PATTERN) -> DataFrame:
    """Every non-empty line of the season files: the fields as text, ``year``,
    ``file``, and ``reason``, why the line is no player's season (NULL if it is
    one). A line without 30 fields is malformed."""
    schema = T.StructType([*CSV_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType(), True)])
    df = (spark.read.schema(schema).option("header", "false").option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").option("columnPruning", "false").csv(path))
    df = df.withColumn("file", F.col("_metadata.file_path"))
    fields = [F.col(f"`{f}`") for f in CSV_FIELDS]
    empty = F.lit(True)
    for f in fields:
        empty = empty & (F.trim(F.coalesce(f, F.lit(""))) == "")
    year = year_of_path(F.col("file"), year_pattern)
    reason = (F.when(F.col("_corrupt_record").isNotNull(), MALFORMED).when(empty, BLANK)
              .when(F.col("Rk") == "Rk", HEADER).when(year.isNull(), NO_SEASON)
              .when(F.trim(F.coalesce(F.col("Player"), F.lit(""))) == "", NO_NAME))
    line = F.coalesce("_corrupt_record", F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields]))
    return df.select(*fields, year.alias("year"), "file", line.alias("line"), reason.alias("reason"))


def kept_and_rejected(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed seasons, rejects): every line is in exactly one of the two. Write
    ``lines`` first if both are used, so that the files are read once."""
    kept = parse_seasons(lines.where("reason IS NULL").drop("file", "line", "reason"))
    return kept, lines.where("reason IS NOT NULL").select("year", "file", "reason", "line")


def counted(lines: DataFrame) -> tuple[DataFrame, Observation]:
    """``lines`` and an observation that counts them in the pass of whatever is
    run on them next: ``lines``, ``kept``, and one number per reason."""
    seen = Observation("season lines")
    reasons = [F.count_if(F.col("reason").eqNullSafe(F.lit(r))).alias(r) for r in REASONS]
    return lines.observe(seen, F.count(F.lit(1)).alias("lines"),
                         F.count_if(F.col("reason").isNull()).alias("kept"), *reasons), seen


def parse_seasons(raw: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """Clean and type the text fields: drop blank and header lines, strip
    '*' and '\\id' from names, blanks -> ``fill`` (0 as the reference),
    unparsable text -> NULL (counted in ``rejects``), NaN -> NULL."""
    df = clean_lines(raw, rank="Rk", name="Player")
    types = {f: ("int" if f in INT_FIELDS else "double") for f in CSV_FIELDS
             if f not in ("Player", "Pos", "Tm")}
    df = typed_parse(df, types, fill=fill)
    # a literal "NaN" parses as NaN; NULL is the only missing value downstream
    df = nan_to_null(df, [f for f, t in types.items() if t == "double"])
    df = df.withColumn("Tm", F.trim("Tm")).withColumn("Pos", F.trim("Pos"))
    out = [F.col("year")] + [F.col(f"`{f}`").alias(RENAME.get(f, f)) for f in CSV_FIELDS] + ["rejects"]
    return df.select(*out)


def stage_season_files(df: DataFrame, path: str, mode: str = "ignore") -> None:
    """Keep the season lines as a table partitioned by year. ``ignore``
    skips the write when the output exists (the reference's dirExists)."""
    df.write.mode(mode).partitionBy("year").parquet(path)


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    """Read staged seasons back; ``year`` filters prune partitions."""
    return spark.read.parquet(path)


def write_season_csv(df: DataFrame, path: str, year_col: str = "year",
                     prefix: str = "leagues", only: bool = False) -> list[str]:
    """Write text season lines as one CSV folder per year named
    ``<prefix>_<year>_...`` (the layout ``read_season_csv`` expects: folders ``season=<prefix>_<year>_``).

    ``df`` holds the 30 fields as text columns plus ``year_col``. Written by
    Spark with ``partitionBy``; the partition folders carry the year. ``only``
    replaces the seasons in ``df`` and leaves the others' files alone.
    """
    (df.select(*[F.col(f"`{f}`") for f in CSV_FIELDS], F.col(year_col).alias("season"))
       .withColumn("season", F.concat(F.lit(f"{prefix}_"), F.col("season").cast("string"), F.lit("_")))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if only else "static").partitionBy("season").option("header", "false").csv(path))
    return [path]
