"""Ad-hoc questions over the scored seasons: top-k lists, one entity's score
line or trajectory, per-period means.

Top-k lists are ``orderBy(...).limit(k)``, which Spark plans as
``TakeOrderedAndProject``: each task keeps its own k best rows and only
those k x tasks rows meet in the final step. Every ordering ends with the
entity (and period) so ties are broken the same way on any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import SeasonSpec


def _q(c: str) -> str:
    return f"`{c}`"


def top_by_season(players: DataFrame, spec: SeasonSpec, period, by: str,
                  k: int = 25, cols: list[str] | None = None) -> DataFrame:
    """The k best entities of one period by a score (descending, NULLs last)."""
    cols = cols or [spec.entity, by]
    return (players.filter(F.col(spec.period) == F.lit(period))
            .select(*[F.col(_q(c)) for c in cols])
            .orderBy(F.col(_q(by)).desc_nulls_last(), F.col(spec.entity).asc())
            .limit(k))


def top_all_time(players: DataFrame, spec: SeasonSpec, by: str, k: int = 50,
                 cols: list[str] | None = None) -> DataFrame:
    """The k best (entity, period) rows over all periods."""
    cols = cols or [spec.entity, spec.period, spec.age, by]
    return (players.select(*[F.col(_q(c)) for c in cols])
            .orderBy(F.col(_q(by)).desc_nulls_last(), F.col(spec.entity).asc(),
                     F.col(spec.period).asc())
            .limit(k))


def top_measure(players: DataFrame, spec: SeasonSpec, by: str, k: int = 20,
                period=None, cols: list[str] | None = None) -> DataFrame:
    """Top k by one measure, in one period (``period``) or over all."""
    if period is not None:
        return top_by_season(players, spec, period, by, k, cols)
    return top_all_time(players, spec, by, k, cols)


def entity_season_line(players: DataFrame, spec: SeasonSpec, entity, period,
                       cols: list[str] | None = None) -> DataFrame:
    """One entity's score line in one period (a conjunctive filter).

    ``entity`` is a key value, or a DataFrame of keys (semi join), e.g. the
    best entity of the period found by ``top_by_season``.
    """
    cols = cols or [spec.entity, *spec.z_cols, spec.z_total]
    rows = players.filter(F.col(spec.period) == F.lit(period))
    if isinstance(entity, DataFrame):
        rows = rows.join(entity.select(spec.entity), spec.entity, "left_semi")
    else:
        rows = rows.filter(F.col(spec.entity) == F.lit(entity))
    return rows.select(*[F.col(_q(c)) for c in cols])


def entity_trajectory(players: DataFrame, spec: SeasonSpec, entities,
                      value: str | None = None) -> DataFrame:
    """A value along age for a few entities (the reference's chart series).

    ``entities`` is a list of key values or a DataFrame of keys (semi join).
    """
    value = value or spec.n_total
    if isinstance(entities, DataFrame):
        rows = players.join(entities.select(spec.entity), spec.entity, "left_semi")
    else:
        rows = players.filter(F.col(spec.entity).isin(list(entities)))
    return (rows.select(spec.entity, spec.period, spec.age, _q(value))
            .orderBy(spec.entity, spec.age, spec.period))


def mean_by_season(players: DataFrame, spec: SeasonSpec, value: str,
                   alias: str | None = None) -> DataFrame:
    """Mean of a value per period (partial + final aggregation)."""
    return players.groupBy(spec.period).agg(F.avg(_q(value)).alias(alias or f"avg_{value}"))


def to_pandas_bounded(df: DataFrame, max_rows: int = 100_000):
    """A local pandas copy of a result known to be small (a top-k list, a
    profile, a chart series). Refuses results above ``max_rows`` instead of
    pulling a whole table through the driver."""
    pdf = df.limit(max_rows + 1).toPandas()
    if len(pdf) > max_rows:
        raise ValueError(f"result has more than {max_rows} rows; aggregate or limit it first")
    return pdf


def local_batches(df: DataFrame) -> Iterator[pa.RecordBatch]:
    """The rows of ``df`` as Arrow batches on the driver, whatever their number:
    fetched partition by partition and packed by the tasks, so the driver holds
    one partition's packed batches at a time and unpacks one."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["packed"])

    for row in df.mapInArrow(pack, "packed binary").toLocalIterator():
        yield from pa.ipc.open_stream(row["packed"])


def save_local(df: DataFrame, path: str) -> int:
    """Write all rows of ``df`` as one Parquet file on the driver, a row group
    per batch; returns their number."""
    rows, writer = 0, None
    for batch in local_batches(df):
        if writer is None:
            writer = pq.ParquetWriter(path, batch.schema)
        writer.write_batch(batch)
        rows += batch.num_rows
    if writer is None:
        pq.write_table(df.limit(0).toArrow(), path)
    else:
        writer.close()
    return rows
