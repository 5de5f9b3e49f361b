"""Per-period scoring: z-scores, volume-weighted impacts, max-abs normalised
scores and their composites.

Three passes, as in the reference, but each "broadcast map" is a per-period
summary DataFrame (one row per period) joined back by a size-checked
broadcast (beyond the limit, replicated over salts), so the season records are
never shuffled by period alone (a few periods would mean a few giant
partitions):

1. summary of raw values per period (avg, population stdev);
2. first-stage values: impact ``(pct - avg) * attempts`` for weighted pairs,
   z for plain measures, negated z for negated ones; their per-period
   summary (avg, stdev, max, min);
3. z of the impacts, max-abs normalisation of every score, composites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import max_abs_normalize, row_sum, weighted_impact, zscore
from ..plans.scope import keep
from ..plans.sizing import checked_broadcast, join_few_keys
from ..spec import NEGATED, WEIGHTED, SeasonSpec


def _q(c: str) -> str:
    return f"`{c}`"


def _raw_inputs(spec: SeasonSpec) -> list[str]:
    seen: list[str] = []
    for m in spec.measures:
        if m.col not in seen:
            seen.append(m.col)
    return seen


def raw_period_summary(df: DataFrame, spec: SeasonSpec) -> DataFrame:
    """Pass 1: avg and population stdev of each scored input, per period."""
    cols = _raw_inputs(spec)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(_q(c)).alias(f"_a1_{i}"), F.stddev_pop(_q(c)).alias(f"_s1_{i}")]
    return df.groupBy(spec.period).agg(*aggs)


def _first_stage_cols(spec: SeasonSpec) -> dict[str, F.Column]:
    idx = {c: i for i, c in enumerate(_raw_inputs(spec))}
    out = {}
    for j, m in enumerate(spec.measures):
        i = idx[m.col]
        a, s = F.col(f"_a1_{i}"), F.col(f"_s1_{i}")
        if m.kind == WEIGHTED:
            v = weighted_impact(F.col(_q(m.col)), a, F.col(_q(m.weight)))
        elif m.kind == NEGATED:
            v = -zscore(F.col(_q(m.col)), a, s)
        else:
            v = zscore(F.col(_q(m.col)), a, s)
        out[f"_v_{j}"] = v
    return out


def first_stage(df: DataFrame, spec: SeasonSpec, s1: DataFrame | None = None,
                small: bool = True) -> DataFrame:
    """Records with pass-2 values ``_v_j`` (impacts / z) attached. Records
    without a period are scored against each other."""
    if s1 is None:
        s1, small = checked_broadcast(raw_period_summary(df, spec))
    joined = join_few_keys(df, s1, spec.period, spec.entity, small)
    return joined.withColumns(_first_stage_cols(spec))


def stage_summary(stage: DataFrame, spec: SeasonSpec) -> DataFrame:
    """Pass 2 summary: avg, population stdev, max, min of each ``_v_j``."""
    aggs = []
    for j in range(len(spec.measures)):
        v = F.col(f"_v_{j}")
        aggs += [F.avg(v).alias(f"_a2_{j}"), F.stddev_pop(v).alias(f"_s2_{j}"),
                 F.max(v).alias(f"_x2_{j}"), F.min(v).alias(f"_n2_{j}")]
    return stage.groupBy(spec.period).agg(*aggs)


def season_scores(df: DataFrame, spec: SeasonSpec, persist_input: bool = True) -> DataFrame:
    """Attach z and n scores of every measure and the two composites.

    ``df`` must hold one row per (entity, period) (see ``dedupe_prefer_total``).
    Output: the input columns, then z of each measure, the z composite, n of
    each measure, the n composite. ``persist_input=False`` when ``df`` is
    already a written table (it is read by all three passes).

    Both summaries have one row per period and the same periods, so one
    measurement of the first, budgeted for the wider second (4 values per
    measure), proves the broadcast bound for both.
    """
    base_cols = df.columns
    if persist_input:
        df = keep(df)
    s1, small = checked_broadcast(raw_period_summary(df, spec),
                                  width_columns=1 + 4 * len(spec.measures))
    stage = first_stage(df, spec, s1, small)
    scored = join_few_keys(stage, stage_summary(stage, spec), spec.period, spec.entity, small)

    z, n = {}, {}
    for j, m in enumerate(spec.measures):
        v = F.col(f"_v_{j}")
        a2, s2c = F.col(f"_a2_{j}"), F.col(f"_s2_{j}")
        mx, mn = F.col(f"_x2_{j}"), F.col(f"_n2_{j}")
        if m.kind == WEIGHTED:
            zc = zscore(v, a2, s2c)
            nc = max_abs_normalize(zc, zscore(mx, a2, s2c), zscore(mn, a2, s2c))
        else:
            zc = v
            nc = max_abs_normalize(v, mx, mn)
        z[spec.z(m)] = zc
        n[spec.n(m)] = nc
    scored = scored.withColumns(z).withColumns(n)
    scored = scored.withColumn(spec.z_total, row_sum([F.col(_q(c)) for c in z]))
    scored = scored.withColumn(spec.n_total, row_sum([F.col(_q(c)) for c in n]))
    out = [*base_cols, *z, spec.z_total, *n, spec.n_total]
    return scored.select(*[F.col(_q(c)) for c in out])


def weighted_impacts(df: DataFrame, spec: SeasonSpec) -> DataFrame:
    """Raw volume-weighted impacts of the weighted pairs (before their own z)."""
    stage = first_stage(df, spec)
    sel = [F.col(f"_v_{j}").alias(f"impact_{m.name}")
           for j, m in enumerate(spec.measures) if m.kind == WEIGHTED]
    return stage.select(spec.entity, spec.period, *sel)


def first_stage_summary(df: DataFrame, spec: SeasonSpec, names=None) -> DataFrame:
    """Pass-2 summary under measure names: ``<m>_count/avg/stdev/max/min``."""
    from .summary import SUMMARY_AGGS, summary_stats

    stage = first_stage(df, spec)
    named = stage.select(spec.period, *[F.col(f"_v_{j}").alias(m.name)
                                        for j, m in enumerate(spec.measures)])
    return summary_stats(named, [spec.period], [m.name for m in spec.measures],
                         names=names or SUMMARY_AGGS)
