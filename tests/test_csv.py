"""Season CSV files in the reference's layout: read, clean, type, dedupe, score."""

import os

import pytest

from stintwise.operators.clean import dedupe_prefer_total
from stintwise.operators.scores import season_scores
from stintwise.sources.csv import parse_seasons, read_season_csv, read_staged, stage_season_files
from stintwise.spec import BASKETBALL, CSV_FIELDS

HEADER = ",".join(CSV_FIELDS)


def _line(rk, name, tm, g, vals, age=25, pos="SF"):
    # 22 measures after Rk..MP; vals: dict field -> text
    fields = [str(rk), name, pos, str(age), tm, str(g), "", "30.0"]
    fields += [vals.get(f, "1.0") for f in CSV_FIELDS[8:]]
    return ",".join(fields)


def _write(tmp_path):
    d = tmp_path / "csv"
    d.mkdir()
    y1 = ["", HEADER,
          _line(1, "Alpha One*", "AAA", 70, {"FG%": ".500", "FGA": "10", "3P": "", "3PA": "", "3P%": ""}),
          _line(2, "Beta Two\\betatw01", "TOT", 60, {"FG%": ".400", "FGA": "12", "PTS": ""}),
          _line(3, "Beta Two", "AAA", 30, {"FG%": ".300"}),
          _line(4, "Beta Two", "BBB", 30, {"FG%": ".500"}),
          HEADER,
          _line(5, "Gamma Three", "CCC", 50, {"FG%": ".600", "FGA": "8", "FT%": "", "FTA": "0.0"},
                pos="SG-PG"),
          _line(6, "Gamma Three", "DDD", 52, {"FG%": ".100", "FGA": "8", "eFG%": "NaN"}),
          ]
    y1[-1] = y1[-1] + ","   # blank last field (PTS) via an extra comma trimmed below
    y1[-1] = y1[-1][:-len(y1[-1].split(",")[-2]) - 2] + ","
    (d / "league_stats_1970_per_game_per_game.csv").write_text("\n".join(y1) + "\n")
    y2 = ["", HEADER, _line(1, "Alpha One*", "AAA", 80, {"FG%": ".550", "FGA": "11"}),
          _line(2, "Gamma Three", "CCC", 40, {"FG%": ".450", "FGA": "9"})]
    (d / "league_stats_1971_per_game_per_game.csv").write_text("\n".join(y2) + "\n")
    return str(d)


def test_read_clean_dedupe_score(spark, tmp_path):
    path = _write(tmp_path)
    raw = read_season_csv(spark, os.path.join(path, "league_stats_*"))
    p = parse_seasons(raw)
    rows = p.collect()
    assert {r["year"] for r in rows} == {1970, 1971}
    assert len(rows) == 8                      # blank and header lines dropped
    names = {r["name"] for r in rows}
    assert names == {"Alpha One", "Beta Two", "Gamma Three"}
    alpha = [r for r in rows if r["name"] == "Alpha One" and r["year"] == 1970][0]
    assert alpha["3P"] == 0.0 and alpha["3PA"] == 0.0 and alpha["gs"] == 0
    gamma6 = [r for r in rows if r["Rk"] == 6][0]
    assert gamma6["PTS"] == 0.0                # blank last field -> 0
    assert gamma6["eFG"] is None               # NaN text -> NULL
    assert all(r["rejects"] == 0 for r in rows)
    gamma5 = [r for r in rows if r["Rk"] == 5][0]
    assert gamma5["position"] == "SG-PG" and gamma5["FTP"] == 0.0   # two positions kept; blank FT% -> 0

    d = {(r["name"], r["year"]): r for r in dedupe_prefer_total(p, BASKETBALL).collect()}
    assert len(d) == 5
    assert d[("Beta Two", 1970)]["team"] == "TOT"
    assert d[("Gamma Three", 1970)]["team"] == "DDD"      # most games wins without TOT

    s = season_scores(dedupe_prefer_total(p, BASKETBALL), BASKETBALL)
    cols = s.columns
    assert cols == [*p.columns, *BASKETBALL.z_cols, "zTOT", *BASKETBALL.n_cols, "nTOT"]
    assert s.count() == 5


def test_year_range_and_staging(spark, tmp_path):
    path = _write(tmp_path)
    raw = read_season_csv(spark, os.path.join(path, "league_stats_*"), first=1971, last=1971)
    assert {r["year"] for r in raw.collect()} == {1971}
    out = str(tmp_path / "staged")
    stage_season_files(parse_seasons(raw), out)
    stage_season_files(parse_seasons(read_season_csv(spark, os.path.join(path, "*"))), out)  # ignored
    staged = read_staged(spark, out)
    assert staged.filter("year = 1971").count() == 2
    assert staged.count() == 2


def test_players_from_csv_end_to_end(spark, tmp_path):
    from stintwise.plans.season_tables import ml_table, players_from_csv, profile_by_age

    path = _write(tmp_path)
    p = players_from_csv(spark, os.path.join(path, "league_stats_*"))
    assert p.columns[0] == "exp" and "zFG" in p.columns and "nTOT" in p.columns
    rows = {(r["name"], r["year"]): r for r in p.collect()}
    assert len(rows) == 5
    assert rows[("Alpha One", 1971)]["exp"] == 0          # same age both years in the fixture
    ml = ml_table(p, BASKETBALL, last=1971)
    assert {"zfg0", "zfg", "zfgdiff", "ztot0"} <= set(ml.columns)
    assert ml.filter("year = 1972").count() == 2           # placeholders for 1971's players
    assert profile_by_age(p, BASKETBALL).count() >= 1


def test_csv_seasons_saved_as_tables(spark, tmp_path):
    from stintwise.plans.season_tables import players_from_csv, write_tables
    from stintwise.sources.catalog import drop_outputs

    path = _write(tmp_path)
    p = players_from_csv(spark, os.path.join(path, "league_stats_*"))
    saved = write_tables(p, BASKETBALL, "seasons_csv", last=1971, similar_targets=["Alpha One"])
    assert saved == ["players", "age", "experience", "ml", "similar"]
    assert spark.table("seasons_csv.players").count() == 5
    assert "Experience" in spark.table("seasons_csv.experience").columns
    assert spark.table("seasons_csv.similar").filter("name = 'Alpha One'").count() > 0
    drop_outputs(spark, "seasons_csv")


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_season_lines_are_built_once_and_experience_before_the_scores(spark, tmp_path):
    from stintwise.plans.more_queries import customer_season_lines
    from stintwise.plans.season_tables import players_from_csv

    # the header and blank lines' seasons come from the written records, not from joins of their own
    spark.sql("""SELECT id AS o_orderkey, id % 3 AS o_custkey, 100.0D AS o_totalprice, '1-URGENT' AS o_orderpriority,
                 timestamp'1995-02-01' + make_interval(CAST(id % 2 AS INT)) AS o_orderdate FROM range(12)""").write.parquet(
        f"{tmp_path}/orders.parquet")
    spark.sql("""SELECT id % 12 AS l_orderkey, 5.0D AS l_quantity, 20.0D AS l_extendedprice, 0.05D AS l_tax, 0.1D AS l_discount,
                 'R' AS l_returnflag, 'O' AS l_linestatus FROM range(30)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    lines = customer_season_lines(spark, str(tmp_path))
    assert "l_orderkey" not in _optimized(lines)
    assert lines.count() == 6 + 2 + 2                       # customer seasons, header and blank lines
    # no shuffle of scored rows: the window by entity is behind the written table
    assert "Window" not in _optimized(players_from_csv(spark, os.path.join(_write(tmp_path), "league_stats_*")))


def test_every_text_is_parsed_once(spark):
    from stintwise.operators.clean import typed_parse

    raw = spark.createDataFrame([("1", " 2.5 "), ("", None), ("x", "  "), (None, "1e3x")], "a string, b string")
    out = typed_parse(raw, {"a": "int", "b": "double"})
    assert [tuple(r) for r in out.collect()] == [(1, 2.5, 0), (0, 0.0, 0), (None, 0.0, 1), (0, None, 1)]
    blank = typed_parse(raw, {"a": "int", "b": "double"}, fill=None)
    assert [tuple(r) for r in blank.collect()] == [(1, 2.5, 0), (None, None, 0), (None, None, 1), (None, None, 1)]
    assert _optimized(out).count("cast(") == 3          # one a field, one of the number of rejects


def test_wide_rows_are_compiled_unless_the_user_says_otherwise(spark):
    from stintwise.session import METHOD_LIMIT_KEY, compile_wide_rows

    before = spark.conf.get(METHOD_LIMIT_KEY)
    try:
        for given, kept in (("65535", "8000"), ("20000", "20000")):
            spark.conf.set(METHOD_LIMIT_KEY, given)
            compile_wide_rows(spark)
            assert spark.conf.get(METHOD_LIMIT_KEY) == kept
    finally:
        spark.conf.set(METHOD_LIMIT_KEY, before)
