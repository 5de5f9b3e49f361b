"""Size-checked broadcast, and what to do beyond its limit.

Per-period summaries have one row per period. That is small in every data
set we know of, but it is not a bound the planner can prove, so the size
is measured before the hint is given. Beyond the limit a shuffle join on the
key alone would gather everything under a handful of keys (periods, season
indexes), so the small side is replicated over salts and the large side is
dealt over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scope import keep, scratch

# Broadcast at most this many bytes, as measured by ``row_bytes``.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def _column_bytes(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(8)


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row in memory: 8 a number, strings and nested values by length."""
    out = F.lit(16)
    for f in df.schema.fields:
        out = out + _column_bytes(F.col(f"`{f.name}`"), f.dataType)
    return out.cast("long")


def checked_broadcast(df: DataFrame, max_bytes: int | None = None,
                      width_columns: int | None = None) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` if its measured size is under ``max_bytes``.

    ``df`` is kept (it is read again by the join), measured, and
    returned with a broadcast hint only when small enough. ``width_columns``
    budgets for a wider table with the same keys (one measurement then proves
    the bound for both). Returns (DataFrame, whether it is broadcast).
    """
    df = keep(df)
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    size += rows * 8 * max((width_columns or 0) - len(df.columns), 0)
    if size <= (MAX_BROADCAST_BYTES if max_bytes is None else max_bytes):
        return F.broadcast(df), True
    return df, False


def join_few_keys(big: DataFrame, small: DataFrame, key: str, spread: str, is_small: bool,
                  salts: int | None = None) -> DataFrame:
    """Inner join on ``key`` (NULL matches NULL), which has few values.

    ``is_small``: ``small`` carries a proven broadcast hint and ``big`` stays
    where it is. Otherwise ``big`` is dealt by (key, salt of ``spread``) and
    ``small`` is replicated once per salt, so that no key lands in one task.
    """
    right = small.withColumnRenamed(key, "_key")
    match = F.col(f"`{key}`").eqNullSafe(F.col("_key"))
    if is_small:
        return big.join(F.broadcast(right), match).drop("_key")
    n = salts or int(big.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    left = big.withColumn("_salt", F.pmod(F.xxhash64(F.col(f"`{spread}`")), F.lit(n)))
    right = right.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return left.join(right, match & (F.col("_salt") == F.col("_copy"))).drop("_key", "_salt", "_copy")


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table under the shared checkpoint folder
    (``spark.checkpoint.dir``) and read it back: one job, durable across lost
    executors, and the planner sees the written table's real size."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
