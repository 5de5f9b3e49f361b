"""Helpers for tables of embedding vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Not null, not all zero, and without null or non-finite components."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def usable_rows(vectors: DataFrame, column: str) -> tuple[DataFrame, int, int]:
    """Rows that take part, their dimension and number. Vectors of another
    length than the longest usable one take no part."""
    rows = vectors.where(usable(F.col(column)))
    d, n = rows.agg(F.max(F.size(column))).first()[0], 0
    if d:
        rows = rows.where(F.size(column) == d)
        n = rows.count()
    return rows, int(d or 0), n


def matrix(column) -> np.ndarray:
    """A batch of arrays as a matrix of doubles."""
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def packed(column, kind=np.float64) -> np.ndarray:
    """A batch of binary vectors as a matrix."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)
