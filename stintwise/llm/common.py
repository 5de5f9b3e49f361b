"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so that a
    lost executor re-reads it and no later job repeats the work behind it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_written(*frames: DataFrame) -> None:
    """Remove tables made by :func:`written` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int,
                       max_bytes: int = 64 << 20) -> DataFrame:
    """Give the broadcast hint only if ``rows`` (counted) fit ``max_bytes``;
    otherwise leave the join to a shuffle with skew handling."""
    return F.broadcast(df) if rows * row_bytes <= max_bytes else df


_SHIPPED: set[str] = set()
#: Spark's default and ours, in rows and bytes.
ROWS_PER_BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")
BYTES_PER_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")


def ship(spark: SparkSession) -> None:
    """Give the executors this package's modules (once per application), for
    clusters where it is installed on the driver only. Whole texts go to Python
    in Arrow batches; Spark's defaults of 10,000 rows and 64 MB a batch are
    lowered to bound a worker's memory (a value set by the user stays)."""
    for name, default, ours in (ROWS_PER_BATCH, BYTES_PER_BATCH):
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="stintwise-")) / "stintwise_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
