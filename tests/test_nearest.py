"""The k-nearest join of careers against brute force, ties, gaps and hot groups."""

import random

import numpy as np
import pytest

from stintwise.operators import nearest
from stintwise.operators.nearest import nearest_careers
from stintwise.spec import PLAIN, Measure, SeasonSpec

SPEC = SeasonSpec(measures=tuple(Measure(f"s{i}", PLAIN, f"s{i}") for i in range(3)))
SCHEMA = "name string, year bigint, zs0 double, zs1 double, zs2 double, other string, cell int"


def careers(n=60, seasons=4, seed=7, copies=0):
    rnd = random.Random(seed)
    rows = []
    for e in range(n):
        centre = 4 * (e % 3)
        for y in range(rnd.randint(1, seasons)):
            rows.append((f"e{e:03d}", 2 * y, *[rnd.gauss(centre, 1) for _ in range(3)], "x", 9))
    for c in range(copies):                                   # a hot group of equal careers
        rows += [(f"c{c:03d}", 5, 1.0, 1.0, 1.0, "x", 9), (f"c{c:03d}", 6, 2.0, 2.0, 2.0, "x", 9)]
    return rows


def brute(rows, asked, k):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    points = {}
    for e, rs in by.items():
        vec = []
        for i, r in enumerate(sorted(rs, key=lambda r: r[1])):
            if any(v is None or v != v for v in r[2:5]):
                break
            vec = vec + list(r[2:5])
            points.setdefault(i, {})[e] = (r[1], np.array(vec))
    out = set()
    for i, at in points.items():
        for e in asked:
            if e in at:
                best = sorted((((v - at[e][1]) ** 2).sum(), o) for o, (_, v) in at.items() if o != e)[:k]
                out |= {(i, at[e][0], e, o, round(float(np.sqrt(d / (3 * (i + 1)))), 9), r + 1)
                        for r, (d, o) in enumerate(best)}
    return out


def got(df):
    return {(r["experience"], r["year"], r["name"], r["similar_player"], round(r["similarity_score"], 9), r["rank"])
            for r in df.collect()}


@pytest.mark.parametrize("block, pivots, copies", [(4096, 256, 0), (4, 5, 30), (7, 1, 0)])
def test_equals_brute_force(spark, block, pivots, copies):
    rows = careers(copies=copies)
    rows += [("gap", 1, 0.0, 0.0, 0.0, "x", 9), ("gap", 2, None, 0.0, 0.0, "x", 9), ("gap", 3, 0.0, 0.0, 0.0, "x", 9),
             ("nan", 1, float("nan"), 0.0, 0.0, "x", 9)]
    p = spark.createDataFrame(rows, SCHEMA)
    asked = sorted({r[0] for r in rows})[::3] + ["gap", "nan", "nobody"]
    t = spark.createDataFrame([(a,) for a in asked * 2], "name string")
    assert got(nearest_careers(p, SPEC, t, k=4, pivots=pivots, block=block)) == brute(rows, asked, 4)


def test_few_careers_and_empty_tables(spark):
    rows = [("a", 1, 0.0, 0.0, 0.0, "", 0), ("b", 1, 1.0, 1.0, 1.0, "", 0), ("b", 2, 1.0, 1.0, 1.0, "", 0)]
    p = spark.createDataFrame(rows, SCHEMA)
    t = spark.createDataFrame([("a",), ("b",)], "name string")
    assert got(nearest_careers(p, SPEC, t)) == {(0, 1, "a", "b", 1.0, 1), (0, 1, "b", "a", 1.0, 1)}
    assert nearest_careers(p.limit(0), SPEC, t).count() == 0
    assert nearest_careers(p, SPEC, t.limit(0)).count() == 0


def test_bounds_leave_cells_out():
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(c, 0.2, (200, 4)) for c in (0, 10, 20, 30)])
    cells = nearest.Cells(points[::100])
    d = cells.distances(points)
    own = d.argmin(axis=1)
    n = len(cells.pivots)
    cells.count = np.bincount(own, minlength=n)
    r = d[np.arange(len(d)), own]
    cells.nearest = np.array([r[own == c].min(initial=0) for c in range(n)])
    cells.farthest = np.array([r[own == c].max(initial=0) for c in range(n)])
    cells.apart = cells.distances(cells.pivots)
    bounds = cells.lower_bounds(d)
    exact = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    for c in range(n):
        if cells.count[c]:
            assert (bounds[:, c] <= exact[:, own == c].min(axis=1) + 1e-9).all()
    assert (bounds > 5).mean() > 0.5                          # far clusters are told apart
    first = cells.first_visits(bounds, d, 6)
    assert ((first * cells.count).sum(axis=1) >= 6).all() and first.mean() < 0.5


def test_plan_joins_bounded_groups(spark):
    p = spark.createDataFrame(careers(), SCHEMA)
    t = p.select("name").distinct()
    plan = nearest_careers(p, SPEC, t)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    for line in plan.splitlines():
        if "Exchange hashpartitioning(season_index" in line:
            keys = line.split("hashpartitioning(")[1].split(")")[0].split(", ")
            assert len([k for k in keys if "#" in k]) > 1, line    # never the index alone
