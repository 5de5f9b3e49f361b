"""Two people of one name are two careers."""

from stintwise.operators.career import season_index
from stintwise.operators.clean import dedupe_prefer_total, namesake_report, split_namesakes, with_namesake_names
from stintwise.spec import SeasonSpec

SPEC = SeasonSpec()
SCHEMA = "name string, year int, team string, age int, gp int, namesake string"


def test_same_season_and_later_career(spark):
    rows = [("George", 1973, "HOU", 25, 19, "x"), ("George", 1973, "GSW", 24, 56, "x"),     # a year apart: one birthday
            ("Charles", 1973, "GSW", 23, 70, "x"), ("Charles", 1974, "GSW", 24, 59, "x"),
            ("Charles", 1973, "CAP", 34, 12, "x"), ("Charles", 1990, "TOT", 22, 80, "x"),
            ("Charles", 1991, None, None, 3, "x"), (None, 1973, "A", 20, 1, "x"), (None, 1973, "A", 40, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = split_namesakes(df, SPEC)
    assert got.count() == len(rows) and got.columns == df.columns
    people = {(r["name"], r["year"], r["age"]): r["namesake"] for r in got.collect()}
    assert people[("George", 1973, 25)] == people[("George", 1973, 24)] == 0
    assert [people[("Charles", y, a)] for y, a in ((1973, 34), (1973, 23), (1974, 24), (1990, 22), (1991, None))] == [0, 1, 1, 2, 0]
    assert {people[(None, 1973, 40)], people[(None, 1973, 20)]} == {0, 1}
    strict = split_namesakes(df, SPEC, gap=0)
    assert {r["namesake"] for r in strict.where("name = 'George'").collect()} == {0, 1}
    kept = dedupe_prefer_total(with_namesake_names(strict, SPEC), SPEC)
    assert {(r["name"], r["team"]) for r in kept.where("name LIKE 'George%'").collect()} == {("George", "HOU"), ("George (2)", "GSW")}
    assert dedupe_prefer_total(df, SPEC).where("name = 'George'").count() == 1                # off by default
    careers = season_index(kept, SPEC).where("name LIKE 'Charles%'")
    assert {r["name"]: r["season_index"] for r in careers.collect()} == {"Charles": 1, "Charles (2)": 1, "Charles (3)": 0}
    report = {r["name"]: (r["people"], r["rows"]) for r in namesake_report(strict, SPEC).collect()}
    assert report == {"George": (2, 2), "Charles": (3, 5), None: (2, 2)}
    assert split_namesakes(df.limit(0), SPEC).count() == 0


def test_dedupe_does_not_depend_on_order(spark):
    rows = [("a", 1, "T", 25, 10, "p"), ("a", 1, "T", 24, 10, "q"), ("a", 1, "T", 24, 10, "b")]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        kept = dedupe_prefer_total(spark.createDataFrame(order, SCHEMA).coalesce(1), SPEC).collect()
        assert [tuple(r) for r in kept] == [("a", 1, "T", 24, 10, "b")]
