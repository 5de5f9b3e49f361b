"""Careers over time: experience, deltas, season index, exclusion, the
next-season roster and the prior-season feature table.

All per-entity operators are windows partitioned by the entity. After
deduplication an entity has at most one row per period, so a window group
is bounded by the number of periods, whatever the data volume; the
partitioning by entity is shared by every window of one plan (one shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..spec import SeasonSpec


def _q(c: str) -> str:
    return f"`{c}`"


def experience(df: DataFrame, spec: SeasonSpec, col: str = "exp") -> DataFrame:
    """exp = age - youngest age seen for the entity; first column, as in the
    reference's players table. Gaps in a career stay gaps."""
    w = Window.partitionBy(spec.entity)
    exp = (F.col(spec.age) - F.min(spec.age).over(w)).cast("bigint")
    return df.select(exp.alias(col), *[F.col(_q(c)) for c in df.columns])


def season_delta(df: DataFrame, spec: SeasonSpec,
                 cols: dict[str, str] | None = None) -> DataFrame:
    """Change of each value since the entity's previous observed period
    (whatever the gap); NULL for its first period.

    ``cols`` maps output delta name -> value column; default deltaZ/deltaN of
    the two composites.
    """
    cols = cols or {"deltaZ": spec.z_total, "deltaN": spec.n_total}
    w = Window.partitionBy(spec.entity).orderBy(spec.period)
    return df.withColumns({d: F.col(_q(v)) - F.lag(_q(v)).over(w) for d, v in cols.items()})


def season_index(df: DataFrame, spec: SeasonSpec, col: str = "season_index") -> DataFrame:
    """0, 1, 2, ... over an entity's periods in order, without gaps."""
    w = Window.partitionBy(spec.entity).orderBy(spec.period)
    return df.withColumn(col, (F.row_number().over(w) - 1).cast("bigint"))


def exclude_first_season(df: DataFrame, spec: SeasonSpec, first) -> DataFrame:
    """Drop every row of entities active in period ``first`` (their careers
    are cut off by the start of the data). Exact membership, not a substring
    test and not a collected list: a flag over the entity's own rows (a
    window by entity, so one pass over ``df`` that shares the entity
    partitioning of the other career windows, instead of joining ``df`` with
    a second computation of itself)."""
    w = Window.partitionBy(spec.entity)
    seen = F.max((F.col(spec.period) == F.lit(first)).cast("int")).over(w)
    return df.withColumn("_first", seen).filter(F.coalesce(F.col("_first"), F.lit(0)) == 0).drop("_first")


def value_rows(players: DataFrame, spec: SeasonSpec) -> DataFrame:
    """Per (entity, period): age, exp, valueZ, valueN, deltaZ, deltaN."""
    d = season_delta(players, spec)
    return d.select(
        spec.entity, spec.period, spec.age, "exp",
        F.col(_q(spec.z_total)).alias("valueZ"), F.col(_q(spec.n_total)).alias("valueN"),
        "deltaZ", "deltaN",
    )


def next_season_roster(players: DataFrame, spec: SeasonSpec, last) -> DataFrame:
    """Players plus one placeholder row per entity active in ``last``:
    period last + 1, exp + 1, age + 1, every other column NULL.

    The reference writes a UNION (distinct) of the table with distinct
    placeholders. With (entity, period) unique, that is one placeholder per
    row of period ``last``. Here each such row is emitted twice by
    ``explode`` and the second copy becomes the placeholder: one pass over
    the table, no union reading it twice, no distinct.
    """
    following = F.lead(spec.period).over(Window.partitionBy(spec.entity).orderBy(spec.period))
    # no placeholder where the entity has a real row in the next period
    is_last = (F.col(spec.period) == F.lit(last)) & ~following.eqNullSafe(F.lit(last) + 1)
    copies = F.when(is_last, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    x = players.withColumn("_copies", copies).withColumn("_ph", F.explode("_copies")).drop("_copies")
    ph = F.col("_ph")
    types = {f.name: f.dataType for f in players.schema.fields}
    out = []
    for c in players.columns:
        col = F.col(_q(c))
        if c == spec.entity:
            expr = col
        elif c == spec.period:
            expr = F.when(ph, F.lit(last) + 1).otherwise(col).cast(types[c])
        elif c in ("exp", spec.age):
            expr = F.when(ph, col + 1).otherwise(col).cast(types[c])
        else:
            expr = F.when(ph, F.lit(None).cast(types[c])).otherwise(col)
        out.append(expr.alias(c))
    return x.select(*out)


def prior_season_features(players: DataFrame, spec: SeasonSpec, last) -> DataFrame:
    """For each (entity, period) whose entity was active exactly one period
    before: carried columns, then per score s: ``s0`` (previous period, NULL
    -> 0), ``s`` (this period), ``sdiff`` (s - s0, NULL -> 0). Placeholder
    rows of period ``last + 1`` are included (NULL ``s``, ``sdiff`` 0).

    One window by entity over the roster replaces the reference's self-join
    and its join back to the roster (same rows: (entity, period) is unique).
    """
    roster = next_season_roster(players, spec, last)
    scores = spec.score_names
    w = Window.partitionBy(spec.entity).orderBy(spec.period)
    prev = F.lag(F.struct(F.col(spec.period).alias("_p"),
                          *[F.col(_q(s)).alias(f"_{i}") for i, s in enumerate(scores)])).over(w)
    t = roster.withColumn("_prev", prev).filter(
        F.col("_prev._p") == F.col(spec.period) - 1
    )
    out = [F.col(spec.entity), F.col(spec.period), F.col(spec.age), F.col("exp"),
           *[F.col(_q(c)) for c in spec.carry if c in players.columns]]
    for i, s in enumerate(scores):
        low = s.lower()
        before = F.col(f"_prev._{i}")
        now = F.col(_q(s))
        out += [F.coalesce(before, F.lit(0.0)).alias(f"{low}0"),
                now.alias(low),
                F.coalesce(now - before, F.lit(0.0)).alias(f"{low}diff")]
    return t.select(*out)
