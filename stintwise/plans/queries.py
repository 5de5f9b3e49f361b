"""

Every query reads the test tables at ``sf_dir`` in full. Customer seasons
stand in for players; supplier seasons serve the pair operators (dense
careers). Double columns are rounded on both sides by magnitude (5 places
below 1e3, 3 below 1e5, else 1), since Spark and DuckDB sum in different
orders; see ``finish`` and ``oracle.rounded``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import career, explore, scores, summary
from ..operators.clean import dedupe_prefer_total
from ..sources.tables import season_records
from ..spec import CUSTOMER
from . import oracle as O
from . import season_tables as st
from .sizing import cut_lineage

# Parameters of the registered questions (the reference asks them of 2016,
# 2015 and all time; here of seasons inside 1995..2001).
SEASON = 1998
OTHER_SEASON = 1997
FIRST = st.FIRST_SEASON
LAST = st.LAST_SEASON

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def round5(c: Column) -> Column:
    """``F.round(c, 5)`` of values below 1e3. Spark rounds by way of a decimal;
    away from a tie the nearest whole number of 1e-5 is the same double, and
    only values within 1e-6 of a tie, far more than the error of the product,
    need the decimal."""
    scaled = c * 1e5
    whole = F.rint(scaled)
    return F.when(F.abs(F.abs(scaled - whole) - 0.5) > 1e-6, whole / 1e5).otherwise(F.round(c, 5))


def finish(df: DataFrame) -> DataFrame:
    """Round double columns by magnitude and fold -0.0 into 0.0 (same rule
    as ``oracle.rounded``): 5 places below 1e3, 3 below 1e5, else 1, so the
    rounding grid stays far above the last-bit noise of summation order."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "double":
            a = F.abs(c)
            c = (F.when(a >= 1e5, F.round(c, 1)).when(a >= 1e3, F.round(c, 3))
                 .otherwise(round5(c)) + F.lit(0.0)).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def register(name: str, sql: str | None = None, doubles: list[str] | None = None):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: finish(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = O.rounded(sql, doubles or [])
        return fn
    return deco


def _players(spark, sf_dir, kind="customer"):
    return st.players(spark, sf_dir, kind)


def _deduped(spark, sf_dir):
    """Customer seasons, one row per (name, year), without scores."""
    return dedupe_prefer_total(season_records(spark, sf_dir, "customer"), CUSTOMER)


def _deduped_table(spark, sf_dir):
    """The same, written once for queries that pass over it twice."""
    return cut_lineage(_deduped(spark, sf_dir), "season-records")


C = CUSTOMER
_C_RAW = list(C.raw)
_C_Z = C.z_cols
_C_N = C.n_cols
_C_PLAYER_DOUBLES = _C_RAW + _C_Z + [C.z_total] + _C_N + [C.n_total]


# --- records, dedupe, summaries -------------------------------------------

@register("dedupe_prefer_total",
          O.with_players("customer", C, "SELECT name, year, team, gp, pct1, m6 FROM dedup"),
          ["pct1", "m6"])
def q_dedupe(spark, sf_dir):
    d = _deduped(spark, sf_dir)
    return d.select("name", "year", "team", "gp", "pct1", "m6")


@register("summary_stats",
          O.with_records("supplier", """
SELECT year, team,
  CAST(count(m1) AS DOUBLE) AS m1_count, avg(m1) AS m1_avg, stddev_pop(m1) AS m1_stdev,
  max(m1) AS m1_max, min(m1) AS m1_min, CAST(count_if(m1 IS NULL) AS DOUBLE) AS m1_missing,
  CAST(count(neg1) AS DOUBLE) AS neg1_count, avg(neg1) AS neg1_avg, stddev_pop(neg1) AS neg1_stdev,
  max(neg1) AS neg1_max, min(neg1) AS neg1_min, CAST(count_if(neg1 IS NULL) AS DOUBLE) AS neg1_missing
FROM records GROUP BY year, team"""),
          [f"{m}_{a}" for m in ("m1", "neg1") for a in ("count", "avg", "stdev", "max", "min", "missing")])
def q_summary_stats(spark, sf_dir):
    recs = season_records(spark, sf_dir, "supplier")
    return summary.summary_stats(recs, ["year", "team"], ["m1", "neg1"], missing=True)


def _summary_sql(cols: list[str], source: str) -> str:
    parts = []
    for c in cols:
        q = f'"{c}"'
        parts.append(f"CAST(count({q}) AS DOUBLE) AS \"{c}_count\", avg({q}) AS \"{c}_avg\", "
                     f"stddev_pop({q}) AS \"{c}_stdev\", CAST(max({q}) AS DOUBLE) AS \"{c}_max\", "
                     f"CAST(min({q}) AS DOUBLE) AS \"{c}_min\"")
    return f"SELECT year, {', '.join(parts)} FROM {source} GROUP BY year"


_AGGS = ("count", "avg", "stdev", "max", "min")


@register("season_summary",
          O.with_players("customer", C, _summary_sql(_C_RAW, "dedup")),
          [f"{m}_{a}" for m in _C_RAW for a in _AGGS])
def q_season_summary(spark, sf_dir):
    d = _deduped(spark, sf_dir)
    return summary.summary_stats(d, ["year"], _C_RAW)


_STAGE_NAMES = [m.name for m in C.measures]


@register("season_z_summary",
          O.with_players("customer", C, _summary_sql(
              _STAGE_NAMES,
              "(SELECT year, " + ", ".join(f'v_{j} AS "{n}"' for j, n in enumerate(_STAGE_NAMES))
              + " FROM w_stage) AS st")),
          [f"{m}_{a}" for m in _STAGE_NAMES for a in _AGGS])
def q_season_z_summary(spark, sf_dir):
    return scores.first_stage_summary(_deduped_table(spark, sf_dir), C)


@register("season_summary_long",
          O.with_players("customer", C, "SELECT year, stat, agg, value FROM ("
                         + " UNION ALL ".join(
                             f"SELECT year, '{m}' AS stat, '{a}' AS agg, \"{m}_{a}\" AS value FROM w_sum"
                             for m in _C_RAW for a in _AGGS) + ") AS l",
                         more=",\nw_sum AS (" + _summary_sql(_C_RAW, "dedup") + ")"),
          ["value"])
def q_season_summary_long(spark, sf_dir):
    return summary.summary_long(q_season_summary(spark, sf_dir), ["year"])


@register("mean_by_season",
          O.with_players("customer", C, "SELECT year, avg(att1) AS avg_att1 FROM players GROUP BY year"),
          ["avg_att1"])
def q_mean_by_season(spark, sf_dir):
    return explore.mean_by_season(_deduped(spark, sf_dir), C, "att1")


# --- scores ----------------------------------------------------------------

@register("season_scores",
          O.with_players("customer", C, "SELECT * FROM players"),
          _C_PLAYER_DOUBLES)
def q_season_scores(spark, sf_dir):
    return _players(spark, sf_dir)


@register("weighted_impact",
          O.with_players("customer", C, "SELECT name, year, v_0 AS impact_w1, v_1 AS impact_w2 FROM w_stage"),
          ["impact_w1", "impact_w2"])
def q_weighted_impact(spark, sf_dir):
    return scores.weighted_impacts(_deduped_table(spark, sf_dir), C)


# --- careers ---------------------------------------------------------------

@register("experience",
          O.with_players("customer", C, "SELECT name, year, age, exp FROM players"))
def q_experience(spark, sf_dir):
    return career.experience(_deduped(spark, sf_dir), C).select("name", "year", "age", "exp")


_VALUE_ROWS_SQL = """,
value_rows AS (
  SELECT name, year, age, exp, "zTOT" AS "valueZ", "nTOT" AS "valueN",
    "zTOT" - lag("zTOT") OVER (PARTITION BY name ORDER BY year) AS "deltaZ",
    "nTOT" - lag("nTOT") OVER (PARTITION BY name ORDER BY year) AS "deltaN"
  FROM players)"""


@register("season_delta",
          O.with_players("customer", C, "SELECT * FROM value_rows", more=_VALUE_ROWS_SQL),
          ["valueZ", "valueN", "deltaZ", "deltaN"])
def q_season_delta(spark, sf_dir):
    return career.value_rows(_players(spark, sf_dir), C)


@register("season_index",
          O.with_players("customer", C, """
SELECT name, year, CAST(row_number() OVER (PARTITION BY name ORDER BY year) - 1 AS BIGINT) AS season_index
FROM players"""))
def q_season_index(spark, sf_dir):
    return career.season_index(_deduped(spark, sf_dir), C).select("name", "year", "season_index")


@register("exclude_first_season",
          O.with_players("customer", C, f"""
SELECT name, year FROM players
WHERE name NOT IN (SELECT name FROM players WHERE year = {FIRST})"""))
def q_exclude_first_season(spark, sf_dir):
    return career.exclude_first_season(_deduped(spark, sf_dir), C, FIRST).select("name", "year")


def _profile_sql(key: str, label: str, where: str = "") -> str:
    parts = []
    for v in ("valueZ", "valueN", "deltaZ", "deltaN"):
        q = f'"{v}"'
        parts.append(f"CAST(count({q}) AS DOUBLE) AS \"{v}_count\", avg({q}) AS \"{v}_mean\", "
                     f"stddev_pop({q}) AS \"{v}_stdev\", max({q}) AS \"{v}_max\", min({q}) AS \"{v}_min\"")
    return f"SELECT {key} AS \"{label}\", {', '.join(parts)} FROM value_rows {where} GROUP BY {key}"


_PROFILE_DOUBLES = [f"{v}_{a}" for v in ("valueZ", "valueN", "deltaZ", "deltaN")
                    for a in ("count", "mean", "stdev", "max", "min")]


@register("profile_by_age",
          O.with_players("customer", C, _profile_sql("age", "age"), more=_VALUE_ROWS_SQL),
          _PROFILE_DOUBLES)
def q_profile_by_age(spark, sf_dir):
    return st.profile_by_age(_players(spark, sf_dir), C)


@register("profile_by_experience",
          O.with_players("customer", C, _profile_sql("exp", "Experience"), more=_VALUE_ROWS_SQL),
          _PROFILE_DOUBLES)
def q_profile_by_experience(spark, sf_dir):
    return st.profile_by_experience(_players(spark, sf_dir), C)


@register("profile_by_experience_excl",
          O.with_players("customer", C, _profile_sql(
              "exp", "Experience",
              f"WHERE name NOT IN (SELECT name FROM players WHERE year = {FIRST})"),
              more=_VALUE_ROWS_SQL),
          _PROFILE_DOUBLES)
def q_profile_by_experience_excl(spark, sf_dir):
    return st.profile_by_experience(_players(spark, sf_dir), C, exclude_first=FIRST)


_PLAYER_COLS = ["exp", "name", "year", "team", "age", "gp", *_C_RAW, *_C_Z, C.z_total, *_C_N, C.n_total]


def _roster_sql() -> str:
    following = ", ".join({"exp": "exp + 1", "age": "age + 1", "name": "name", "year": "year + 1"}
                          .get(c, f'NULL AS "{c}"') for c in _PLAYER_COLS)
    return f""",
roster AS (
  SELECT * FROM players
  UNION ALL
  SELECT {following} FROM players WHERE year = {LAST})"""


@register("next_season_roster",
          O.with_players("customer", C, "SELECT * FROM roster", more=_roster_sql()),
          _C_PLAYER_DOUBLES)
def q_next_season_roster(spark, sf_dir):
    return career.next_season_roster(_players(spark, sf_dir), C, LAST)


def _ml_sql() -> str:
    priors = "".join(f', lag("{s}") OVER career AS "before_{s}"' for s in C.score_names)
    features = "".join(f', coalesce("before_{s}", 0) AS {s.lower()}0, "{s}" AS {s.lower()}, '
                       f'coalesce("{s}" - "before_{s}", 0) AS {s.lower()}diff' for s in C.score_names)
    return f"""
SELECT name, year, age, exp, team, gp{features}
FROM (SELECT *, lag(year) OVER career AS year_before{priors}
      FROM roster WINDOW career AS (PARTITION BY name ORDER BY year)) AS in_order
WHERE year_before = year - 1"""


_ML_DOUBLES = [f"{s.lower()}{x}" for s in C.score_names for x in ("0", "", "diff")]


@register("prior_season_features",
          O.with_players("customer", C, _ml_sql(), more=_roster_sql()),
          _ML_DOUBLES)
def q_prior_season_features(spark, sf_dir):
    return st.ml_table(_players(spark, sf_dir), C, LAST)


# --- explore ---------------------------------------------------------------

def _top_sql(where: str, cols: list[str], by: str, k: int, extra_order: str = "") -> str:
    sel = ", ".join(f'"{c}"' for c in cols)
    return (f'SELECT {sel} FROM players {where} ORDER BY "{by}" DESC NULLS LAST, name ASC'
            f'{extra_order} LIMIT {k}')


@register("top_by_season",
          O.with_players("customer", C, _top_sql(f"WHERE year = {SEASON}", ["name", "zTOT"], "zTOT", 25)),
          ["zTOT"])
def q_top_by_season(spark, sf_dir):
    return explore.top_by_season(_players(spark, sf_dir), C, SEASON, "zTOT", 25)


@register("top_by_season_ntot",
          O.with_players("customer", C, _top_sql(f"WHERE year = {OTHER_SEASON}", ["name", "nTOT"], "nTOT", 25)),
          ["nTOT"])
def q_top_by_season_ntot(spark, sf_dir):
    return explore.top_by_season(_players(spark, sf_dir), C, OTHER_SEASON, "nTOT", 25)


@register("top_measure",
          O.with_players("customer", C, _top_sql(f"WHERE year = {SEASON}", ["name", "m1", "zm1"], "zm1", 20)),
          ["m1", "zm1"])
def q_top_measure(spark, sf_dir):
    return explore.top_measure(_players(spark, sf_dir), C, "zm1", 20, period=SEASON,
                               cols=["name", "m1", "zm1"])


@register("top_measure_all_time",
          O.with_players("customer", C, _top_sql("", ["name", "year", "m1", "zm1"], "m1", 20, ", year ASC")),
          ["m1", "zm1"])
def q_top_measure_all_time(spark, sf_dir):
    return explore.top_measure(_players(spark, sf_dir), C, "m1", 20, cols=["name", "year", "m1", "zm1"])


@register("top_all_time",
          O.with_players("customer", C, _top_sql("", ["name", "year", "age", "nTOT"], "nTOT", 50, ", year ASC")),
          ["nTOT"])
def q_top_all_time(spark, sf_dir):
    return explore.top_all_time(_players(spark, sf_dir), C, "nTOT", 50)


@register("top_all_time_ztot",
          O.with_players("customer", C, _top_sql("", ["name", "year", "age", "zTOT"], "zTOT", 50, ", year ASC")),
          ["zTOT"])
def q_top_all_time_ztot(spark, sf_dir):
    return explore.top_all_time(_players(spark, sf_dir), C, "zTOT", 50)


@register("top_measure_all_time_z",
          O.with_players("customer", C, _top_sql("", ["name", "year", "m1", "zm1"], "zm1", 20, ", year ASC")),
          ["m1", "zm1"])
def q_top_measure_all_time_z(spark, sf_dir):
    return explore.top_measure(_players(spark, sf_dir), C, "zm1", 20, cols=["name", "year", "m1", "zm1"])


_BEST_OF_SEASON = (f"(SELECT name FROM players WHERE year = {SEASON} "
                   f'ORDER BY "zTOT" DESC NULLS LAST, name LIMIT 1)')


@register("entity_season_line",
          O.with_players("customer", C, "SELECT name, " + ", ".join(f'"{c}"' for c in _C_Z + ["zTOT"])
                         + f" FROM players WHERE year = {SEASON} AND name = {_BEST_OF_SEASON}"),
          _C_Z + ["zTOT"])
def q_entity_season_line(spark, sf_dir):
    p = cut_lineage(_players(spark, sf_dir), "players")   # read twice: best of season, then its line
    best = explore.top_by_season(p, C, SEASON, "zTOT", 1).select("name")
    return explore.entity_season_line(p, C, best, SEASON)


@register("entity_trajectory",
          O.with_players("customer", C, """
SELECT name, year, age, "nTOT" FROM players
WHERE name IN (SELECT name FROM players ORDER BY "zTOT" DESC NULLS LAST, name, year LIMIT 3)"""),
          ["nTOT"])
def q_entity_trajectory(spark, sf_dir):
    p = cut_lineage(_players(spark, sf_dir), "players")   # read twice: best seasons, then their series
    top = explore.top_all_time(p, C, "zTOT", 3).select("name").distinct()
    return explore.entity_trajectory(p, C, top, "nTOT")


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import more_queries  # noqa: F401  (registers the rest)
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import more_queries  # noqa: F401
    return dict(ORACLE)
