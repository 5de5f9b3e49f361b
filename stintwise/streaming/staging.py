"""Incremental staging of season files.

The reference stages its per-year CSV files once (one job per year, skipped
when the output folder exists) and has no stream otherwise. Here the same
step is a file-source stream: each run picks up only season files it has
not seen (the stream's checkpoint records them, so a rerun or a lost
executor neither duplicates nor drops a file) and appends the cleaned,
typed lines to a table partitioned by year. ``availableNow`` processes what
is there and stops, so it runs as a batch job on a schedule.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.csv import CSV_SCHEMA, YEAR_PATTERN, parse_seasons


def stage_new_season_files(spark: SparkSession, source_glob: str, target: str,
                           checkpoint: str, max_files_per_trigger: int | None = None):
    """Append cleaned lines of season files not staged yet to ``target``
    (parquet, partitioned by year). Returns the finished query."""
    reader = spark.readStream.schema(CSV_SCHEMA).option("header", "false")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    raw = reader.csv(source_glob).withColumn(
        "year", F.regexp_extract(F.col("_metadata.file_path"), YEAR_PATTERN, 1).try_cast("int"))
    q = (parse_seasons(raw).writeStream.format("parquet")
         .option("checkpointLocation", checkpoint)
         .partitionBy("year").outputMode("append")
         .trigger(availableNow=True).start(target))
    q.awaitTermination()
    return q
