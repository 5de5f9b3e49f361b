"""Registered queries for cleaning, the CSV path, compared careers and
prediction (see ``queries.py`` for the conventions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, moments, nearest, predict, search, similar
from ..operators.clean import dedupe_prefer_total
from ..session import compile_wide_rows
from ..sources import csv as csvsrc
from ..sources.tables import load, season_records
from ..sources import catalog, seasons
from ..spec import BASKETBALL, CSV_FIELDS, CSV_RAW, CUSTOMER, SUPPLIER
from . import oracle as O
from .scope import scratch
from .sizing import cut_lineage
from . import season_tables as st
from .queries import LAST, _ml_sql, _roster_sql, register

C, S = CUSTOMER, SUPPLIER


# --- cleaning (dirty text made from every customer row) --------------------

def dirty_names(spark, sf_dir):
    """Customer names with the reference's dirt: a '*' mark, a '\\id'
    suffix, repeated header lines and blank lines among the rows."""
    cust = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    player = F.concat(
        F.col("c_name"),
        F.when(k % 3 == 0, F.lit("*")).otherwise(F.lit("")),
        F.when(k % 5 == 0, F.concat(F.lit("\\id"), k.cast("string"))).otherwise(F.lit("")))
    rows = cust.select(k.cast("string").alias("Rk"), player.alias("Player"))
    # a repeated header line per nation, a blank line per market segment
    headers = cust.select("c_nationkey").distinct().select(
        F.lit("Rk").alias("Rk"), F.lit("Player").alias("Player"))
    blanks = cust.select("c_mktsegment").distinct().select(
        F.lit(None).cast("string").alias("Rk"), F.lit(None).cast("string").alias("Player"))
    return rows.unionByName(headers).unionByName(blanks)


@register("clean_lines", "SELECT CAST(c_custkey AS BIGINT) AS Rk, c_name AS Player FROM customer")
def q_clean_lines(spark, sf_dir):
    out = clean.clean_lines(dirty_names(spark, sf_dir), rank="Rk", name="Player")
    return out.select(F.col("Rk").try_cast("bigint").alias("Rk"), "Player")


def _acct_text(k, blank_every=4, space_every=7):
    return (F.when(k % blank_every == 0, F.lit(""))
            .when(k % space_every == 0, F.lit("  "))
            .otherwise(F.col("c_acctbal").cast("string")))


@register("blank_to_zero", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 7 = 0 THEN 0.0 ELSE c_acctbal END AS acctbal
FROM customer""", ["acctbal"])
def q_blank_to_zero(spark, sf_dir):
    cust = load(spark, sf_dir, "customer")
    text = cust.select("c_custkey", _acct_text(F.col("c_custkey")).alias("acctbal"))
    return clean.blank_to_zero(text, ["acctbal"])


@register("typed_parse", """
SELECT c_custkey,
  CAST(CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE c_nationkey END AS BIGINT) AS nationkey,
  CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 0.0 ELSE c_acctbal END AS acctbal,
  CAST(CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS rejects
FROM customer""", ["acctbal"])
def q_typed_parse(spark, sf_dir):
    cust = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    text = cust.select(
        "c_custkey",
        F.when(k % 9 == 0, F.lit("")).otherwise(F.col("c_nationkey").cast("string")).alias("nationkey"),
        F.when(k % 6 == 0, F.lit("n/a")).when(k % 4 == 0, F.lit(""))
        .otherwise(F.col("c_acctbal").cast("string")).alias("acctbal"))
    out = clean.typed_parse(text, {"nationkey": "int", "acctbal": "double"})
    return out.select("c_custkey", F.col("nationkey").cast("bigint").alias("nationkey"),
                      "acctbal", "rejects")


@register("nan_to_null", """
SELECT c_custkey, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_acctbal END AS acctbal FROM customer""",
          ["acctbal"])
def q_nan_to_null(spark, sf_dir):
    cust = load(spark, sf_dir, "customer")
    v = F.when(F.col("c_custkey") % 8 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    return clean.nan_to_null(cust.select("c_custkey", v.alias("acctbal")))


# --- the CSV path: customer seasons written as season files, read back -----

# Which record column fills which CSV field ('' = left blank).
_CSV_MAP = {
    "Pos": None, "Age": "age", "Tm": "team", "G": "gp", "FG": "m1", "FGA": "att1",
    "FG%": "pct1", "3P": "m2", "2P": "m3", "2PA": "m4", "FT": "m5", "FTA": "att2",
    "FT%": "pct2", "TOV": "neg1", "PTS": "m6",
}


def customer_season_lines(spark, sf_dir, mapping=_CSV_MAP):
    # written once: the lines, and the seasons of header and blank lines, are read from it
    recs = cut_lineage(season_records(spark, sf_dir, "customer"), "csv-records")
    n = F.col("name")
    fields = {}
    for f in CSV_FIELDS:
        if f == "Rk":
            fields[f] = n.cast("string")
        elif f == "Player":
            fields[f] = F.concat(F.lit("C"), n.cast("string"),
                                 F.when(n % 3 == 0, F.lit("*")).otherwise(F.lit("")),
                                 F.when(n % 5 == 0, F.concat(F.lit("\\c"), n.cast("string")))
                                 .otherwise(F.lit("")))
        elif f == "Pos":
            fields[f] = F.lit("G")
        elif mapping.get(f):
            fields[f] = F.col(mapping[f]).cast("string")
        else:
            fields[f] = F.lit("")
    lines = recs.select("year", *[c.alias(f) for f, c in fields.items()])
    years = recs.select("year").distinct()
    header = years.select("year", *[F.lit(f).alias(f) for f in CSV_FIELDS])
    blank = years.select("year", *[F.lit(None).cast("string").alias(f) for f in CSV_FIELDS])
    return lines.unionByName(header).unionByName(blank)


@register("read_season_csv", O.with_records("customer", """
SELECT CAST(name AS BIGINT) AS Rk, 'C' || CAST(name AS VARCHAR) AS name, year, age, team, gp,
  CAST(0 AS BIGINT) AS gs, m1 AS "FG", att1 AS "FGA", pct1 AS "FGP", neg1 AS "TOV", m6 AS "PTS",
  CAST(0 AS BIGINT) AS rejects
FROM records"""), ["FG", "FGA", "FGP", "TOV", "PTS"])
def q_read_season_csv(spark, sf_dir):
    path = scratch(spark, "season-csv")
    csvsrc.write_season_csv(customer_season_lines(spark, sf_dir), path)
    raw = csvsrc.read_season_csv(spark, path)   # the folder; partition folders carry the year
    p = csvsrc.parse_seasons(raw)
    return p.select(
        F.col("Rk").try_cast("bigint").alias("Rk"), "name", F.col("year").cast("bigint").alias("year"),
        F.col("age").cast("bigint").alias("age"), "team", F.col("gp").cast("bigint").alias("gp"),
        F.col("gs").cast("bigint").alias("gs"), "FG", "FGA", "FGP", "TOV", "PTS", "rejects")


# A record column for every scored field; the other measures are left blank (0).
_SCORED_MAP = {
    "Age": "age", "Tm": "team", "G": "gp", "MP": "att1", "FG": "m1", "FGA": "att1", "FG%": "pct1", "FTA": "att2",
    "FT%": "pct2", "3P": "m2", "TRB": "m3", "AST": "m4", "STL": "m5", "BLK": "m6", "TOV": "neg1", "PTS": "m1",
}
_RAW_OF = dict(zip(CSV_RAW, CSV_FIELDS[8:]))        # players column -> CSV field
_PLAYER_DOUBLES = [*CSV_RAW, *BASKETBALL.z_cols, "zTOT", *BASKETBALL.n_cols, "nTOT"]
_PLAYERS_51 = ["exp", "name", "year", "age", "position", "team", "gp", "gs", "mp", *_PLAYER_DOUBLES]
_CSV_RECORDS = """,
csv_records AS (
  SELECT 'C' || CAST(name AS VARCHAR) AS name, year, age, team, gp, 'G' AS position, CAST(0 AS BIGINT) AS gs,
    CAST(att1 AS DOUBLE) AS mp, """ + ", ".join(
        f'CAST({_SCORED_MAP.get(_RAW_OF[c], "0")} AS DOUBLE) AS "{c}"' for c in CSV_RAW) + """
  FROM records)"""


def _csv_players(spark, sf_dir):
    """Customer seasons through season files: written, read, cleaned, scored."""
    compile_wide_rows(spark)
    path = scratch(spark, "season-csv")
    csvsrc.write_season_csv(customer_season_lines(spark, sf_dir, _SCORED_MAP), path)
    p = st.players_from_csv(spark, path)
    return p.select(*[F.col(c).cast("bigint").alias(c) if c in ("exp", "year", "age", "gp", "gs") else F.col(f"`{c}`")
                      for c in _PLAYERS_51])


_PLAYERS_51_SQL = "SELECT " + ", ".join(f'"{c}"' for c in _PLAYERS_51) + " FROM players"
_FROM_CSV = _CSV_RECORDS + O.score_ctes(BASKETBALL, "csv_records", "position, gs, mp, ")


@register("players_from_csv", O.with_records("customer", _PLAYERS_51_SQL, more=_FROM_CSV), ["mp", *_PLAYER_DOUBLES])
def q_players_from_csv(spark, sf_dir):
    return _csv_players(spark, sf_dir)


SAVED = "stintwise_saved"


@register("saved_players", O.with_records("customer", _PLAYERS_51_SQL, more=_FROM_CSV), ["mp", *_PLAYER_DOUBLES])
def q_saved_players(spark, sf_dir):
    """The same table saved beside its last version, checked, swapped in, and
    read through the catalog."""
    # a database per application: an in-memory catalog does not know the folders of earlier ones
    db = f"{SAVED}_{spark.sparkContext.applicationId}".replace("-", "_")
    catalog.create_database(spark, db)
    one_row_each = lambda t: t.groupBy("name", "year").count().where("count > 1").isEmpty()
    catalog.save_and_swap(_csv_players(spark, sf_dir), f"{db}.players", verify=one_row_each, partition_by=["year"])
    return spark.table(f"{db}.players").select(*[f"`{c}`" for c in _PLAYERS_51])


# Dirt of the reject query, by the record's key.
_EXTRA, _NAMELESS, _STRAY = "name % 70 = 1", "name % 50 = 0", "name % 90 = 2"


@register("rejects", O.with_records("customer", f"""
SELECT reason, CAST(count(*) AS BIGINT) AS lines FROM (
  SELECT CASE WHEN {_EXTRA} THEN 'malformed line' WHEN {_STRAY} THEN 'no season in path'
              WHEN {_NAMELESS} THEN 'blank name' ELSE 'kept' END AS reason FROM records
  UNION ALL SELECT 'repeated header' FROM (SELECT DISTINCT year FROM records)
  UNION ALL SELECT 'blank line' FROM (SELECT DISTINCT year FROM records)
  UNION ALL SELECT 'lines' FROM records
  UNION ALL SELECT 'lines' FROM (SELECT DISTINCT year FROM records), (VALUES (1), (2)) AS t(i))
GROUP BY reason"""))
def q_rejects(spark, sf_dir):
    """Where every line of dirty season files goes: kept, or rejected and why."""
    lines = customer_season_lines(spark, sf_dir, _SCORED_MAP)
    key = F.col("Rk").try_cast("bigint")
    fields = [F.when((key % 50 == 0) & (F.lit(f) == "Player"), F.lit("")).otherwise(F.coalesce(f"`{f}`", F.lit("")))
              for f in CSV_FIELDS]
    text = F.concat(F.concat_ws(",", *fields), F.when(key % 70 == 1, F.lit(",31")).otherwise(F.lit("")))
    folder = F.when(key % 90 == 2, F.lit("notes")).otherwise(F.concat(F.lit("leagues_"), F.col("year"), F.lit("_")))
    path = scratch(spark, "dirty-csv")
    lines.select(text.alias("value"), folder.alias("season")).write.partitionBy("season").text(path)
    read = csvsrc.read_season_lines(spark, path)
    where = F.array(F.coalesce("reason", F.lit("kept")), F.lit("lines"))
    return read.select(F.explode(where).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


@register("staged_seasons", O.with_records("customer", f"""
SELECT year, CAST(count(*) AS BIGINT) AS lines, CAST(sum(gp) AS BIGINT) AS games, min(name) AS first_name
FROM records WHERE year <> {LAST} OR name % 2 = 0 GROUP BY year"""))
def q_staged_seasons(spark, sf_dir):
    """Season files staged by year; the last season's files are then replaced by
    others, and staging runs again."""
    source, target = scratch(spark, "season-csv"), scratch(spark, "staged")
    lines = customer_season_lines(spark, sf_dir)
    csvsrc.write_season_csv(lines, source)
    seasons.stage_changed(spark, source, target)
    csvsrc.write_season_csv(lines.where((F.col("year") == LAST) & (F.col("Rk").try_cast("bigint") % 2 == 0)), source, only=True)
    seasons.stage_changed(spark, source, target)
    staged = csvsrc.read_staged(spark, target)
    return staged.groupBy(F.col("year").cast("bigint").alias("year")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("gp").cast("bigint").alias("games"),
        F.min(F.col("Rk").cast("bigint")).alias("first_name"))


# --- kept summaries and namesakes ------------------------------------------

_DIRTY = "CASE WHEN name % 7 = 0 THEN NULL WHEN name % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE {0} END"
_KEPT = ("att1", "m2", "m6")


def _moments_sql(key: str, group: str) -> str:
    return " UNION ALL ".join(f"""
SELECT {key} AS year, '{m}' AS stat, CAST(count(v) AS DOUBLE) AS count, avg(v) AS avg, stddev_pop(v) AS stdev,
  max(v) AS max, min(v) AS min, CAST(count_if(v IS NULL) AS DOUBLE) AS missing
FROM (SELECT year, CASE WHEN name % 7 = 0 OR name % 11 = 0 THEN NULL ELSE {m} END AS v FROM dedup) AS t {group}""" for m in _KEPT)


@register("season_moments", O.with_players("customer", C, _moments_sql("year", "GROUP BY year") + " UNION ALL "
                                           + _moments_sql("CAST(NULL AS BIGINT)", "")),
          ["count", "avg", "stdev", "max", "min", "missing"])
def q_season_moments(spark, sf_dir):
    """Kept season summaries: all seasons but the last loaded first, the last one
    added by reading it alone; merged per season and over all time."""
    table, path = scratch(spark, "seasons"), scratch(spark, "moments")
    rows = clean.dedupe_prefer_total(season_records(spark, sf_dir, "customer"), C)
    (rows.select("year", *[F.expr(_DIRTY.format(m)).alias(m) for m in _KEPT])
     .write.partitionBy("year").parquet(table))
    kept = spark.read.parquet(table)
    moments.add_load(moments.partial_state(kept.where(F.col("year") != LAST), ["year"], list(_KEPT)), path, "first")
    moments.add_load(moments.partial_state(kept.where(F.col("year") == LAST), ["year"], list(_KEPT)), path, str(LAST))
    states = moments.read_loads(spark, path)
    per_season = moments.finished(moments.merged(states, ["year"]), ["year"])
    all_time = moments.finished(moments.merged(states, []), [])
    return per_season.withColumn("year", F.col("year").cast("bigint")).unionByName(
        all_time.withColumn("year", F.lit(None).cast("bigint")))


@register("namesakes", O.with_records("customer", """
SELECT name, year, age, team, gp, namesake FROM (
  SELECT t.*, s.namesake FROM t JOIN (
    SELECT name, born, CAST(sum(new) OVER (PARTITION BY name ORDER BY born) AS INTEGER) AS namesake FROM (
      SELECT name, born, CASE WHEN born - lag(born) OVER (PARTITION BY name ORDER BY born) > 1 THEN 1 ELSE 0 END AS new
      FROM (SELECT DISTINCT name, born FROM t))) AS s ON s.name = t.name AND s.born = t.born)""", more=""",
t AS (SELECT name % 300 AS name, year, age, team, gp, year - age AS born FROM records)"""))
def q_namesakes(spark, sf_dir):
    """Season records in which many people share a name, told apart by age."""
    rows = season_records(spark, sf_dir, "customer").withColumn("name", F.col("name") % 300)
    return clean.split_namesakes(rows.select("name", "year", "age", "team", "gp"), C)


# --- compared careers (supplier seasons: dense careers) --------------------

_S_Z = S.z_cols


def _career_rows_sql() -> str:
    zs = ", ".join(f'"{c}"' for c in _S_Z)
    return f""",
cr AS (
  SELECT name, year, row_number() OVER (PARTITION BY name ORDER BY year) - 1 AS season_index, {zs}
  FROM players)"""


@register("career_vector", O.with_players("supplier", S, f"""
SELECT name, year, CAST(season_index AS BIGINT) AS season_index,
  CAST({len(_S_Z)} * (season_index + 1) AS BIGINT) AS vec_len,
  sum({" + ".join(f'"{c}"' for c in _S_Z)}) OVER (
    PARTITION BY name ORDER BY season_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vec_sum
FROM cr""", more=_career_rows_sql()), ["vec_sum"])
def q_career_vector(spark, sf_dir):
    v = similar.career_vector(st.players(spark, sf_dir, "supplier"), S)
    return v.select("name", "year", "season_index",
                    F.size("vec").cast("bigint").alias("vec_len"),
                    F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("vec_sum"))


#: Compared careers are asked of every entity whose key this number divides.
ASK_EVERY = 20


def asked_entities(players, every=ASK_EVERY):
    return players.where(F.col("name") % every == 0).select("name").distinct()


_SIM_SQL = f""",
pairs AS (
  SELECT t.season_index AS experience, t.year AS year, t.name AS name, o.name AS similar_player,
    {" + ".join(f'(o."{c}" - t."{c}") * (o."{c}" - t."{c}")' for c in _S_Z)} AS d2
  FROM cr AS o JOIN cr AS t ON o.season_index = t.season_index AND o.name <> t.name
  WHERE t.name % {ASK_EVERY} = 0),
sim AS (
  SELECT CAST(experience AS BIGINT) AS experience, year, name, similar_player,
    CASE WHEN count(*) OVER upto = count(d2) OVER upto
         THEN sqrt(sum(d2) OVER upto / ({float(len(_S_Z))} * (experience + 1))) END AS similarity_score
  FROM pairs
  WINDOW upto AS (PARTITION BY name, similar_player ORDER BY experience
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@register("career_similarity", O.with_players("supplier", S, "SELECT * FROM sim",
                                              more=_career_rows_sql() + _SIM_SQL),
          ["similarity_score"])
def q_career_similarity(spark, sf_dir):
    p = cut_lineage(st.players(spark, sf_dir, "supplier"), "players")   # read for targets and careers
    return similar.career_similarity(p, S, asked_entities(p))


@register("most_similar_topk", O.with_players("supplier", S, """
SELECT experience, year, name, similar_player, similarity_score, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY name, experience
                               ORDER BY similarity_score, similar_player) AS rank
  FROM sim WHERE similarity_score IS NOT NULL)
WHERE rank <= 5""", more=_career_rows_sql() + _SIM_SQL), ["similarity_score"])
def q_most_similar_topk(spark, sf_dir):
    p = cut_lineage(st.players(spark, sf_dir, "supplier"), "players")   # read for targets and careers
    return nearest.nearest_careers(p, S, asked_entities(p), k=5)


# --- prediction ------------------------------------------------------------

def _ml(spark, sf_dir):
    return st.ml_table(st.players(spark, sf_dir, "customer"), C, LAST)


_ML_CTE = _roster_sql() + ",\nml AS (" + _ml_sql() + ")"


@register("train_split", O.with_players("customer", C, f"""
SELECT name, year, exp, zw10, zw1 AS label FROM ml WHERE year >= {LAST} AND year < {LAST + 1}""",
                                        more=_ML_CTE), ["zw10", "label"])
def q_train_split(spark, sf_dir):
    return predict.split(_ml(spark, sf_dir), "zw1", LAST)


@register("ols_two_feature", O.with_players("customer", C, f"""
SELECT n, coef_1, coef_2, my - coef_1 * m1 - coef_2 * m2 AS intercept FROM (
  SELECT n, m1, m2, my,
    (v2 * c1y - c12 * c2y) / NULLIF(v1 * v2 - c12 * c12, 0) AS coef_1,
    (v1 * c2y - c12 * c1y) / NULLIF(v1 * v2 - c12 * c12, 0) AS coef_2
  FROM (
    SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my,
      var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c12,
      covar_pop(x1, y) AS c1y, covar_pop(x2, y) AS c2y
    FROM (SELECT CAST(exp AS DOUBLE) AS x1, zw10 AS x2, zw1 AS y FROM ml
          WHERE year >= {LAST} AND year < {LAST + 1}
            AND exp IS NOT NULL AND zw10 IS NOT NULL AND zw1 IS NOT NULL)))""",
                                            more=_ML_CTE), ["coef_1", "coef_2", "intercept"])
def q_ols_two_feature(spark, sf_dir):
    return predict.ols_two_feature(predict.split(_ml(spark, sf_dir), "zw1", LAST), "exp", "zw10")


def _predictions(spark, sf_dir, train_year, stats=predict.MEASURES):
    # the feature table is read by the fit and by the prediction: write it once
    ml = cut_lineage(_ml(spark, sf_dir), "ml-features")
    return search.predict(ml, search.fit(ml, stats, train_year), stats, train_year + 1)


def _search_sql(train_year: int, stats=predict.MEASURES) -> str:
    """Plain SQL of the same search: coefficients from the rows of the training
    fold, errors row by row over the validation fold."""
    rows = " UNION ALL ".join(
        f"SELECT '{s}' AS stat, CASE WHEN substr(md5(concat_ws('|', name, year)), 1, 1) IN ('0', '4', '8', 'c') "
        f"THEN 'v' ELSE 't' END AS part, CAST(exp AS DOUBLE) AS x1, {s}0 AS x2, {s} AS y FROM ml WHERE year = {train_year}"
        for s in stats)
    after = " UNION ALL ".join(
        f"SELECT '{s}' AS stat, name, year, CAST(exp AS DOUBLE) AS x1, {s}0 AS x2, {s} AS y FROM ml WHERE year = {train_year + 1}"
        for s in stats)
    regs, nets = (", ".join(f"({v})" for v in vs) for vs in (predict.REG_PARAMS, predict.ELASTIC_NET))
    return f""",
fit_rows AS (SELECT * FROM ({rows}) AS u WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND y IS NOT NULL),
sets AS (SELECT 't' AS s, * FROM fit_rows WHERE part = 't' UNION ALL SELECT 'e' AS s, * FROM fit_rows),
moments AS (
  SELECT s, stat, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2,
    stddev_pop(y) AS sy, avg(x1 * x1) AS q11, avg(x2 * x2) AS q22, avg(x1 * x2) AS q12, avg(x1 * y) AS q1y,
    avg(x2 * y) AS q2y, covar_pop(x1, x2) AS k12, covar_pop(x1, y) AS k1y, covar_pop(x2, y) AS k2y
  FROM sets GROUP BY s, stat),
grid AS (
  SELECT CAST(reg AS DOUBLE) AS reg, icpt, CAST(net AS DOUBLE) AS net
  FROM (VALUES {regs}) AS a(reg), (VALUES (true), (false)) AS b(icpt), (VALUES {nets}) AS c(net)),
scaled AS (
  SELECT *, reg * net / sy AS t,
    CASE WHEN icpt THEN 1 ELSE q11 / (s1 * s1) END + reg * (1 - net) / sy AS g11,
    CASE WHEN icpt THEN 1 ELSE q22 / (s2 * s2) END + reg * (1 - net) / sy AS g22,
    CASE WHEN icpt THEN k12 ELSE q12 END / (s1 * s2) AS g12,
    CASE WHEN icpt THEN k1y ELSE q1y END / (s1 * sy) AS a1,
    CASE WHEN icpt THEN k2y ELSE q2y END / (s2 * sy) AS a2
  FROM moments, grid),
points AS (
  SELECT *,
    CASE WHEN i = 0 THEN 0 WHEN j = 0 THEN (a1 - i * t) / g11
         ELSE (g22 * (a1 - i * t) - g12 * (a2 - j * t)) / (g11 * g22 - g12 * g12) END AS w1,
    CASE WHEN j = 0 THEN 0 WHEN i = 0 THEN (a2 - j * t) / g22
         ELSE (g11 * (a2 - j * t) - g12 * (a1 - i * t)) / (g11 * g22 - g12 * g12) END AS w2
  FROM scaled, (VALUES (-1), (0), (1)) AS u(i), (VALUES (-1), (0), (1)) AS v(j)),
solved AS (
  SELECT s, stat, reg, icpt, net, m1, m2, my, w1 * sy / s1 AS b1, w2 * sy / s2 AS b2
  FROM (SELECT *, row_number() OVER (
          PARTITION BY s, stat, reg, icpt, net
          ORDER BY g11 * w1 * w1 / 2 + g22 * w2 * w2 / 2 + g12 * w1 * w2 - a1 * w1 - a2 * w2
                   + t * (abs(w1) + abs(w2))) AS place FROM points)
  WHERE place = 1),
coefs AS (SELECT *, CASE WHEN icpt THEN my - b1 * m1 - b2 * m2 ELSE 0 END AS b0 FROM solved),
errors AS (
  SELECT f.stat, reg, icpt, net, sqrt(avg((y - b0 - b1 * x1 - b2 * x2) * (y - b0 - b1 * x1 - b2 * x2))) AS rmse
  FROM coefs c JOIN fit_rows f ON f.stat = c.stat AND c.s = 't' AND f.part = 'v'
  GROUP BY f.stat, reg, icpt, net),
best AS (
  SELECT stat, reg, icpt, net FROM (
    SELECT *, row_number() OVER (PARTITION BY stat ORDER BY rmse, reg DESC, icpt DESC, net) AS place FROM errors)
  WHERE place = 1),
predicted AS (
  SELECT a.stat, name, year, b0 + b1 * x1 + b2 * x2 AS prediction, y AS label
  FROM ({after}) AS a JOIN best USING (stat)
  JOIN coefs c ON c.stat = a.stat AND c.s = 'e' AND c.reg = best.reg AND c.icpt = best.icpt AND c.net = best.net),
summed AS (
  SELECT name, year, sum(prediction) AS prediction,
    CASE WHEN count(label) = count(*) THEN sum(label) END AS label
  FROM predicted GROUP BY name, year)"""


@register("next_season_prediction", O.with_players("customer", C, "SELECT name, year, prediction, label FROM predicted",
                                                   more=_ML_CTE + _search_sql(LAST, ("zw1",))), ["prediction", "label"])
def q_next_season_prediction(spark, sf_dir):
    return search.one_prediction(_predictions(spark, sf_dir, LAST, ("zw1",)), "zw1")


@register("combined_prediction", O.with_players("customer", C, "SELECT * FROM summed",
                                                more=_ML_CTE + _search_sql(LAST)), ["prediction", "label"])
def q_combined_prediction(spark, sf_dir):
    return search.summed(_predictions(spark, sf_dir, LAST), predict.MEASURES)


@register("predicted_rank", O.with_players("customer", C, """
SELECT * FROM summed ORDER BY prediction DESC NULLS LAST, name LIMIT 100""",
                                           more=_ML_CTE + _search_sql(LAST)), ["prediction", "label"])
def q_predicted_rank(spark, sf_dir):
    return predict.predicted_rank(search.summed(_predictions(spark, sf_dir, LAST), predict.MEASURES), 100)


@register("prediction_rmse", O.with_players("customer", C, """
SELECT count(*) AS n, sqrt(avg((prediction - label) * (prediction - label))) AS rmse
FROM predicted WHERE prediction IS NOT NULL AND label IS NOT NULL""",
                                            more=_ML_CTE + _search_sql(LAST - 1, ("zw1",))), ["rmse"])
def q_prediction_rmse(spark, sf_dir):
    """Held-out score: train on the season before the last, test on the last."""
    return predict.prediction_rmse(search.one_prediction(_predictions(spark, sf_dir, LAST - 1, ("zw1",)), "zw1"))


@register("model_search", O.with_players("customer", C, """
SELECT stat, reg, icpt AS intercept, net, rmse FROM errors""",
                                         more=_ML_CTE + _search_sql(LAST)), ["reg", "net", "rmse"])
def q_model_search(spark, sf_dir):
    """The validation error of every candidate of the grid."""
    moments = search.season_moments(search.training_rows(_ml(spark, sf_dir), predict.MEASURES, LAST))
    tried = [m for stat, folds in moments.items() for m in search.candidates(stat, folds)]
    return spark.createDataFrame([(m.stat, m.reg, m.intercept, m.net, m.rmse) for m in tried],
                                 "stat string, reg double, intercept boolean, net double, rmse double")


# dedupe is re-exported for callers that build their own records
__all__ = ["dirty_names", "customer_season_lines", "dedupe_prefer_total"]
