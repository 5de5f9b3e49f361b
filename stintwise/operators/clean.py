"""Cleaning and deduplication of season records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import blank_to_zero as _blank_to_zero
from ..functions.columns import clean_name
from ..functions.columns import nan_to_null as _nan_to_null
from ..spec import SeasonSpec


def clean_lines(df: DataFrame, rank: str = "Rk", name: str = "Player") -> DataFrame:
    """Drop blank lines and repeated header lines; strip '*' and '\\id' from names.

    ``df`` holds the CSV fields as text. A blank line reads as all-NULL
    fields; a header line repeats the field names (its rank field reads
    ``rank``). A player's line whose rank is blank stays.
    """
    return (
        df.filter(F.col(name).isNotNull())
        .filter(~F.col(rank).eqNullSafe(F.lit(rank)))
        .withColumn(name, clean_name(name))
    )


def blank_to_zero(df: DataFrame, cols: list[str], to: str = "double",
                  fill: float | None = 0.0) -> DataFrame:
    """Blank numeric text -> ``fill`` (0 by default, as the reference does)."""
    return df.withColumns({c: _blank_to_zero(F.col(f"`{c}`"), to, fill) for c in cols})


def typed_parse(df: DataFrame, types: dict[str, str], fill: float | None = 0.0,
                reject_col: str | None = "rejects") -> DataFrame:
    """Cast text columns to their types; blanks become ``fill``.

    Text that does not parse becomes NULL instead of failing the job, and
    the number of such fields per row is counted in ``reject_col``.
    """
    parsed = {c: f"_parsed_{i}" for i, c in enumerate(c for c in df.columns if c in types)}
    # trimmed, then parsed, then judged: every text is parsed once
    text = df.withColumns({c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in parsed})
    typed = text.withColumns({p: F.col(f"`{c}`").try_cast(types[c]) for c, p in parsed.items()})
    cols, bad = [], []
    for name in df.columns:
        raw = F.col(f"`{name}`")
        if name not in types:
            cols.append(raw)
            continue
        value = F.col(parsed[name])
        filled = value if fill is None else F.when(raw.isNull(), F.lit(fill).cast(types[name])).otherwise(value)
        cols.append(filled.alias(name))
        bad.append(F.when(raw.isNotNull() & value.isNull(), 1).otherwise(0))
    if reject_col and bad:
        total = bad[0]
        for b in bad[1:]:
            total = total + b
        cols.append(total.cast("bigint").alias(reject_col))
    return typed.select(*cols)


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Turn NaN into NULL, the one missing value used downstream."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: _nan_to_null(c) for c in cols})


def dedupe_prefer_total(df: DataFrame, spec: SeasonSpec) -> DataFrame:
    """One row per (entity, period): the season-total club row if present,
    otherwise the row with most games, then smallest club, then lowest rank,
    then the least in the other columns.

    ``row_number() = 1`` over (entity, period) in that total order (no
    dependence on shuffle arrival order). Spark plans it with a partial
    ``WindowGroupLimit`` before the shuffle: each task keeps one row per
    (entity, period), so a hot key never gathers its rows in one task.
    """
    order = [
        F.col(spec.club).eqNullSafe(F.lit(spec.total_club)).desc(),
        F.col(spec.games).desc_nulls_last(),
        F.col(spec.club).asc_nulls_last(),
    ]
    if spec.rank and spec.rank in df.columns:
        order.append(F.col(spec.rank).asc_nulls_last())
    # a unique last key: rows equal so far differ in some column, or not at all
    order += [F.col(f"`{f.name}`").asc_nulls_last() for f in df.schema.fields
              if f.name not in (spec.entity, spec.period, spec.games, spec.club, spec.rank)
              and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    w = Window.partitionBy(spec.entity, spec.period).orderBy(*order)
    return (df.withColumn("_pick", F.row_number().over(w))
            .filter(F.col("_pick") == 1).drop("_pick"))


NAMESAKE = "namesake"


def split_namesakes(df: DataFrame, spec: SeasonSpec, gap: int = 1) -> DataFrame:
    """Tell entities of one name apart by the birth year that their age implies.

    Birth years of a name that lie more than ``gap`` apart (ages are taken on
    different days of a season) belong to different people. Adds ``namesake``:
    0 for the earliest born, 1 for the next, ...; rows without age or period
    are 0. Apply it before ``dedupe_prefer_total``, which otherwise keeps one row
    of two people; ``with_namesake_names`` makes them two entities.

    Sessions are cut on the distinct (name, birth year) pairs, at most a
    lifetime's worth per name, and joined back, so that a name held by a third
    of all rows never gathers them in one window.
    """
    born = F.col(spec.period).cast("long") - F.col(spec.age).cast("long")
    pairs = df.select(F.col(spec.entity).alias("_name"), born.alias("_born")).where("_born IS NOT NULL").distinct()
    by = Window.partitionBy("_name").orderBy("_born")
    new = (F.col("_born") - F.lag("_born").over(by) > gap).cast("int")
    sessions = pairs.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn(
        "_session", F.sum("_new").over(by).cast("int")).select("_name", "_born", "_session")
    joined = df.withColumn("_own", born).join(
        sessions, F.col(f"`{spec.entity}`").eqNullSafe(F.col("_name")) & (F.col("_own") == F.col("_born")), "left")
    return joined.withColumn(NAMESAKE, F.coalesce("_session", F.lit(0))).drop("_own", "_name", "_born", "_session")


def with_namesake_names(df: DataFrame, spec: SeasonSpec) -> DataFrame:
    """Entities renamed "<name> (2)", "<name> (3)", ... for later namesakes; the
    entity column must be text."""
    later = F.concat(F.col(f"`{spec.entity}`"), F.lit(" ("), (F.col(NAMESAKE) + 1).cast("string"), F.lit(")"))
    return df.withColumn(spec.entity, F.when(F.col(NAMESAKE) > 0, later).otherwise(F.col(f"`{spec.entity}`")))


def namesake_report(df: DataFrame, spec: SeasonSpec) -> DataFrame:
    """(name, people, rows): the names held by several people."""
    return (df.groupBy(F.col(spec.entity).alias("name")).agg(
        (F.max(NAMESAKE) + 1).cast("bigint").alias("people"), F.count(F.lit(1)).alias("rows")).where("people > 1"))
