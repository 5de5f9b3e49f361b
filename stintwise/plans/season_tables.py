"""The reference's tables as DataFrame plans.

``players`` (scored, deduplicated seasons with experience), ``age`` and
``experience`` profiles, ``ml`` (prior-season features); ``write_all`` saves
them as catalog tables. Building ``players`` runs jobs: it writes the
deduplicated records and counts the per-period summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.career import (exclude_first_season, experience,
                                prior_season_features, value_rows)
from ..operators.clean import dedupe_prefer_total
from ..operators.scores import season_scores
from ..operators.summary import profile
from .sizing import cut_lineage as lineage_cut
from ..sources.tables import season_records
from ..spec import BASKETBALL, CUSTOMER, SUPPLIER, SeasonSpec

# Seasons of the test tables: order / ship years 1995 to 2001.
FIRST_SEASON = 1995
LAST_SEASON = 2001

SPECS = {"customer": CUSTOMER, "supplier": SUPPLIER}

PROFILE_VALUES = ["valueZ", "valueN", "deltaZ", "deltaN"]


def players_from_records(records: DataFrame, spec: SeasonSpec,
                         cut_lineage: bool = True) -> DataFrame:
    """records -> one row per (entity, period) -> experience -> scores.

    The deduplicated records feed three passes (two summaries and the final
    scores). With ``cut_lineage`` they are first written as a table in the
    shared ``spark.checkpoint.dir`` and read back: a lost executor then
    re-reads that table instead of replaying the scan, joins and three
    aggregations below it.
    """
    # experience comes first: its shuffle by entity then carries no scores
    dedup = experience(dedupe_prefer_total(records, spec), spec)
    if cut_lineage:
        dedup = lineage_cut(dedup, "season-records")
    return season_scores(dedup, spec, persist_input=not cut_lineage)


def players(spark: SparkSession, sf_dir: str, kind: str = "customer") -> DataFrame:
    spec = SPECS[kind]
    return players_from_records(season_records(spark, sf_dir, kind), spec)


def players_from_csv(spark: SparkSession, path: str, first: int | None = None,
                     last: int | None = None, spec: SeasonSpec = BASKETBALL) -> DataFrame:
    """The reference's whole ingest: season CSV files under ``path`` (a glob)
    -> clean, typed lines -> one row per (name, year) -> scores -> exp."""
    from ..sources.csv import parse_seasons, read_season_csv

    return players_from_records(parse_seasons(read_season_csv(spark, path, first, last)), spec)


def profile_by_age(players_df: DataFrame, spec: SeasonSpec) -> DataFrame:
    return profile(value_rows(players_df, spec), spec.age, PROFILE_VALUES)


def profile_by_experience(players_df: DataFrame, spec: SeasonSpec,
                          exclude_first: object | None = None) -> DataFrame:
    """Profile by experience. ``exclude_first`` = a period whose entities are
    left out (the reference means to leave out the first season's players but
    its test never matches, so the default keeps everyone)."""
    rows = value_rows(players_df, spec)
    if exclude_first is not None:
        rows = exclude_first_season(rows, spec, exclude_first)
    return profile(rows, "exp", PROFILE_VALUES, label="Experience")


def ml_table(players_df: DataFrame, spec: SeasonSpec, last=LAST_SEASON) -> DataFrame:
    return prior_season_features(players_df, spec, last)


def write_tables(players_df: DataFrame, spec: SeasonSpec, db: str, last,
                 similar_targets=None) -> list[str]:
    """Save a players DataFrame and the tables derived from it (age,
    experience, ml, and ``similar`` for ``similar_targets``) in ``db``; without
    targets there is no ``similar``, as the returned names say.
    Works for any source: test tables, or season CSV files via
    ``players_from_csv``."""
    from ..operators.similar import career_similarity
    from ..sources.catalog import create_database, write_table

    spark = players_df.sparkSession
    create_database(spark, db)
    write_table(players_df, f"{db}.players", partition_by=[spec.period])   # one-season reads prune
    saved = spark.table(f"{db}.players")
    write_table(profile_by_age(saved, spec), f"{db}.age")
    write_table(profile_by_experience(saved, spec), f"{db}.experience")
    write_table(ml_table(saved, spec, last), f"{db}.ml")
    out = ["players", "age", "experience", "ml"]
    if similar_targets is not None:
        write_table(career_similarity(saved, spec, similar_targets), f"{db}.similar")
        out.append("similar")
    return out


def write_all(spark: SparkSession, sf_dir: str, db: str, kind: str = "customer",
              last=LAST_SEASON, similar_targets: DataFrame | None = None) -> list[str]:
    """Build the players table of the test tables and save it with the
    derived tables (see ``write_tables``)."""
    return write_tables(players(spark, sf_dir, kind), SPECS[kind], db, last, similar_targets)
