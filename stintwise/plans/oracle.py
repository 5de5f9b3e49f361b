"""DuckDB SQL for the correctness check: the same questions answered by
plain SQL over the raw test tables, written independently of the
DataFrame code (window + join + GROUP BY, no shared helpers besides the
column roles of the spec)."""

from __future__ import annotations

from ..sources.tables import AGE_SPREAD, BIRTH_BASE
from ..spec import NEGATED, WEIGHTED, SeasonSpec

_SUMS_SQL = """count(*) AS n_lines,
    sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_r,
    sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS n_o,
    sum(l_quantity) AS s_qty, sum(round(l_extendedprice * 100)) AS s_price,
    sum(round(l_tax * 100)) AS s_tax,
    sum(round(l_extendedprice * 100) * (100 - round(l_discount * 100))) AS s_net,
    sum(round(l_discount * 100)) AS s_disc"""

_SUM_NAMES = ["n_lines", "n_r", "n_o", "s_qty", "s_price", "s_tax", "s_net", "s_disc"]


def _records_tail(extra: list[str]) -> str:
    sums = ["gp"] + _SUM_NAMES + extra
    tot_cols = ", ".join(f"sum({c}) AS {c}" for c in sums)
    cols = ", ".join(sums)
    m6 = ",\n    s_total / (CAST(gp AS DOUBLE) * 100) AS m6" if "s_total" in extra else ""
    return f"""
w_tot AS (
  SELECT name, year, 'TOT' AS team, {tot_cols}
  FROM w_club GROUP BY name, year HAVING count(*) >= 2),
w_rows AS (
  SELECT name, year, team, {cols} FROM w_club
  UNION ALL
  SELECT name, year, team, {cols} FROM w_tot),
records AS (
  SELECT CAST(name AS BIGINT) AS name, CAST(year AS BIGINT) AS year, team,
    CAST(year - {BIRTH_BASE} - name % {AGE_SPREAD} AS BIGINT) AS age,
    CAST(gp AS BIGINT) AS gp,
    n_r / CAST(n_lines AS DOUBLE) AS pct1,
    n_lines / CAST(gp AS DOUBLE) AS att1,
    n_o / CAST(n_lines AS DOUBLE) AS pct2,
    s_qty / CAST(gp AS DOUBLE) AS att2,
    s_qty / CAST(n_lines AS DOUBLE) AS m1,
    s_price / (CAST(n_lines AS DOUBLE) * 100) AS m2,
    s_tax / (CAST(n_lines AS DOUBLE) * 100) AS m3,
    n_lines / CAST(gp AS DOUBLE) AS m4,
    s_net / (CAST(n_lines AS DOUBLE) * 10000) AS m5{m6},
    s_disc / (CAST(n_lines AS DOUBLE) * 100) AS neg1
  FROM w_rows)"""


def records_ctes(kind: str) -> str:
    """CTEs ending in ``records``: one row per (entity, period, club) + TOT."""
    if kind == "customer":
        head = f"""
w_order AS (
  SELECT l_orderkey, {_SUMS_SQL}
  FROM lineitem GROUP BY l_orderkey),
w_club AS (
  SELECT o_custkey AS name, year(o_orderdate) AS year, o_orderpriority AS team,
    count(*) AS gp, {", ".join(f"sum({c}) AS {c}" for c in _SUM_NAMES)},
    sum(round(o_totalprice * 100)) AS s_total
  FROM orders JOIN w_order ON o_orderkey = l_orderkey
  GROUP BY 1, 2, 3),"""
        return head + _records_tail(["s_total"])
    head = f"""
w_order AS (
  SELECT l_suppkey AS name, year(l_shipdate) AS year, l_returnflag AS team, l_orderkey,
    {_SUMS_SQL}
  FROM lineitem GROUP BY 1, 2, 3, 4),
w_club AS (
  SELECT name, year, team, count(*) AS gp,
    {", ".join(f"sum({c}) AS {c}" for c in _SUM_NAMES)}
  FROM w_order GROUP BY 1, 2, 3),"""
    return head + _records_tail([])


def _q(c: str) -> str:
    return f'"{c}"'


def _raw_inputs(spec: SeasonSpec) -> list[str]:
    seen: list[str] = []
    for m in spec.measures:
        if m.col not in seen:
            seen.append(m.col)
    return seen


def players_ctes(kind: str, spec: SeasonSpec) -> str:
    """CTEs ending in ``dedup`` (one row per entity, period) and ``players``."""
    return records_ctes(kind) + score_ctes(spec)


def score_ctes(spec: SeasonSpec, source: str = "records", carry: str = "") -> str:
    """CTEs ``dedup`` to ``players`` over the records in ``source``; ``carry``
    names further columns to keep."""
    raw = _raw_inputs(spec)
    idx = {c: i for i, c in enumerate(raw)}
    s1 = ", ".join(f"avg({_q(c)}) AS a1_{i}, stddev_pop({_q(c)}) AS s1_{i}" for i, c in enumerate(raw))
    vs = []
    for j, m in enumerate(spec.measures):
        i = idx[m.col]
        if m.kind == WEIGHTED:
            vs.append(f"({_q(m.col)} - a1_{i}) * {_q(m.weight)} AS v_{j}")
        elif m.kind == NEGATED:
            vs.append(f"-(({_q(m.col)} - a1_{i}) / NULLIF(s1_{i}, 0)) AS v_{j}")
        else:
            vs.append(f"({_q(m.col)} - a1_{i}) / NULLIF(s1_{i}, 0) AS v_{j}")
    s2 = ", ".join(
        f"avg(v_{j}) AS a2_{j}, stddev_pop(v_{j}) AS s2_{j}, max(v_{j}) AS x2_{j}, min(v_{j}) AS n2_{j}"
        for j in range(len(spec.measures)))
    zs, ns = [], []
    for j, m in enumerate(spec.measures):
        if m.kind == WEIGHTED:
            z = f"((v_{j} - a2_{j}) / NULLIF(s2_{j}, 0))"
            bound = (f"greatest(abs((x2_{j} - a2_{j}) / NULLIF(s2_{j}, 0)), "
                     f"abs((n2_{j} - a2_{j}) / NULLIF(s2_{j}, 0)))")
        else:
            z = f"v_{j}"
            bound = f"greatest(abs(x2_{j}), abs(n2_{j}))"
        zs.append((spec.z(m), z))
        ns.append((spec.n(m), f"({z} / NULLIF({bound}, 0))"))
    zsel = ",\n    ".join(f"{e} AS {_q(n)}" for n, e in zs)
    nsel = ",\n    ".join(f"{e} AS {_q(n)}" for n, e in ns)
    ztot = " + ".join(e for _, e in zs)
    ntot = " + ".join(e for _, e in ns)
    return f""",
dedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY name, year ORDER BY (team <> 'TOT'), gp DESC, team) AS rn
    FROM {source}) WHERE rn = 1),
w_s1 AS (SELECT year, {s1} FROM dedup GROUP BY year),
w_stage AS (
  SELECT d.*, {", ".join(vs)}
  FROM dedup d JOIN w_s1 USING (year)),
w_s2 AS (SELECT year, {s2} FROM w_stage GROUP BY year),
scored AS (
  SELECT w_stage.*, {zsel},
    {ztot} AS {_q(spec.z_total)},
    {nsel},
    {ntot} AS {_q(spec.n_total)}
  FROM w_stage JOIN w_s2 USING (year)),
players AS (
  SELECT CAST(age - min(age) OVER (PARTITION BY name) AS BIGINT) AS exp,
    name, year, team, age, gp, {carry}{", ".join(_q(c) for c in spec.raw)},
    {", ".join(_q(spec.z(m)) for m in spec.measures)}, {_q(spec.z_total)},
    {", ".join(_q(spec.n(m)) for m in spec.measures)}, {_q(spec.n_total)}
  FROM scored)"""


def with_players(kind: str, spec: SeasonSpec, body: str, more: str = "") -> str:
    return "WITH " + players_ctes(kind, spec).lstrip() + more + "\n" + body


def with_records(kind: str, body: str, more: str = "") -> str:
    return "WITH " + records_ctes(kind).lstrip() + more + "\n" + body


def rounded(sql: str, doubles: list[str]) -> str:
    """Round double columns by magnitude (5 places below 1e3, 3 below 1e5,
    else 1), in a final select.

    Spark rounds a double half-up on its shortest decimal form; DuckDB's
    round() works on the binary value, which differs on exact ties (money
    sums divided by 4, 8, ...). So the value is rounded here as a decimal
    parsed from its text form, like Spark does.
    """
    if not doubles:
        return sql

    def r(c):
        q = _q(c)
        d = f"CAST(CAST({q} AS VARCHAR) AS DECIMAL(38, 12))"
        return (f"CASE WHEN abs({q}) >= 1e5 THEN CAST(round({d}, 1) AS DOUBLE) "
                f"WHEN abs({q}) >= 1e3 THEN CAST(round({d}, 3) AS DOUBLE) "
                f"ELSE CAST(round({d}, 5) AS DOUBLE) END AS {q}")

    rep = ", ".join(r(c) for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS final_rows"
