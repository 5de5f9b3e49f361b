"""Ownership of cached frames and scratch tables.

Operators that read a frame several times persist it or write it to the shared
checkpoint folder. Both belong to the innermost open scope::

    with owned(spark):
        top = nearest_careers(...)
        top.write.saveAsTable("seasons.similar")
    # caches are released and scratch folders removed here

A lazily evaluated result must be consumed inside its scope. Outside any scope
they belong to the session until ``release_session(spark)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


class Scope:
    """Frames persisted and folders written on behalf of one owner."""

    def __init__(self, spark: SparkSession):
        self.spark, self.frames, self.paths = spark, [], []

    def release(self) -> None:
        """Unpersist and delete, newest first."""
        while self.frames:
            self.frames.pop().unpersist()
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        while self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(conf).delete(path, True)


_OPEN: ContextVar[tuple[Scope, ...]] = ContextVar("stintwise_scopes", default=())
_SESSION: dict[str, Scope] = {}


def _current(spark: SparkSession) -> Scope:
    if _OPEN.get():
        return _OPEN.get()[-1]
    return _SESSION.setdefault(spark.sparkContext.applicationId, Scope(spark))


@contextmanager
def owned(spark: SparkSession) -> Iterator[Scope]:
    """A scope that owns what is kept inside it, and releases it at its end,
    also when the work fails."""
    scope = Scope(spark)
    token = _OPEN.set((*_OPEN.get(), scope))
    try:
        yield scope
    finally:
        _OPEN.reset(token)
        scope.release()


def release_session(spark: SparkSession) -> None:
    """Release what was kept outside any scope."""
    scope = _SESSION.pop(spark.sparkContext.applicationId, None)
    if scope:
        scope.release()


def keep(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Persist ``df`` until its scope ends."""
    df = df.persist(level)
    _current(df.sparkSession).frames.append(df)
    return df


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, removed with its scope."""
    path = scratch_path(spark, name)
    _current(spark).paths.append(path)
    return path
