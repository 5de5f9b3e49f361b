"""The k most similar careers of every asked entity at every season index: an
exact metric k-nearest join without all pairs.

At index e a career is a point, its scores of seasons 0..e laid end to end, and
similarity is the Euclidean distance of two points (over the root of their
length). Per index:

1. A few careers serve as pivots. Every career goes to the cell of its nearest
   pivot and keeps the distance to it; cells are split into blocks by size.
2. A query's distances to the pivots bound its distance to every cell from
   below: by the triangle inequality over the cell's nearest and farthest
   member, and by the plane half-way between two pivots.
3. The cells with the lowest bounds that hold more than k careers give k
   distances. The k-th bounds the answer from above, so only cells whose lower
   bound does not exceed it are visited next; inside a cell only members whose
   pivot distance fits (the ring) are compared.

The join key is (index, cell, block, group of queries): bounded groups on both
sides, whatever the size of an index or a cell. k rows leave a group per query.
Pivots and cell bounds are the only data sent to tasks; their size is bounded
by ``PIVOTS`` an index and checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import MAX_BROADCAST_BYTES, cut_lineage
from ..session import ship_package
from ..spec import SeasonSpec
from .similar import career_rows

PIVOTS = 256
BLOCK = 4096            # careers, or queries, of one group at most, up to the evenness of a hash
SLACK = 1e-9            # of bounds, against rounding

GROUP = ["season_index", "cell", "block", "near", "part"]


def career_points(players: DataFrame, spec: SeasonSpec) -> DataFrame:
    """(entity, period, season_index, vec). A career with an undefined score has
    no point from that season on: it is neither asked nor near."""
    rows = career_rows(players, spec)
    w = (Window.partitionBy("entity").orderBy("season_index")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.select(F.col(spec.entity).alias("entity"), F.col(spec.period).alias("period"), "season_index",
                       F.array(*[F.col(f"`{c}`").cast("double") for c in spec.z_cols]).alias("season"))
    undefined = F.exists("season", lambda v: v.isNull() | F.isnan(v))
    return rows.select("entity", "period", "season_index", F.max(undefined).over(w).alias("_undefined"),
                       F.flatten(F.collect_list("season").over(w)).alias("vec")).where("NOT _undefined").drop("_undefined")


@dataclass
class Cells:
    """Pivots of one season index, and what the cells around them hold."""

    pivots: np.ndarray
    block: int = BLOCK
    asked: int = 0                  # queries of the index
    count: np.ndarray | None = None
    nearest: np.ndarray | None = None
    farthest: np.ndarray | None = None
    apart: np.ndarray | None = None

    def distances(self, points: np.ndarray) -> np.ndarray:
        out = np.empty((len(points), len(self.pivots)))
        for i, p in enumerate(self.pivots):
            out[:, i] = np.sqrt(((points - p) ** 2).sum(axis=1))
        return out

    def lower_bounds(self, d: np.ndarray) -> np.ndarray:
        """Least distance from each query to any member of each cell, given its
        distances to the pivots; infinite for empty cells."""
        own = d.argmin(axis=1)
        ring = np.maximum(d - self.farthest, self.nearest - d)
        least = d[np.arange(len(d)), own][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d ** 2 - least ** 2) / (2 * self.apart[own])
        plane[~np.isfinite(plane)] = 0.0
        return np.where(self.count > 0, np.maximum(np.maximum(ring, plane), 0.0), np.inf)

    def first_visits(self, bounds: np.ndarray, d: np.ndarray, enough: int) -> np.ndarray:
        """Cells in the order of their bounds (then pivots) until they hold ``enough``."""
        order = np.lexsort((d, bounds))
        held = np.cumsum(self.count[order], axis=1) - self.count[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, held < enough, axis=1)
        return out & (self.count > 0)

    def blocks(self) -> np.ndarray:
        return -(-self.count // self.block)

    def query_group(self, own: np.ndarray) -> np.ndarray:
        """Cells whose queries are asked together: as many as hold about a block
        of them, one if a cell alone does."""
        return own // max(1, len(self.pivots) * self.block // max(self.asked, 1))


def choose_pivots(points: DataFrame, most: int = PIVOTS, block: int = BLOCK) -> dict[int, Cells]:
    """A quarter of the root of an index's number of careers, those with the least
    hash: cells of a few dozen careers would cost more to hand out than to compare."""
    sizes = {r["season_index"]: (r["n"], r["d"]) for r in points.groupBy("season_index").agg(
        F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).collect()}     # one row per index
    dims = sum(d for _, d in sizes.values())
    most = max(1, min(most, MAX_BROADCAST_BYTES // (8 * max(dims, 1))))
    per = max([min(most, int(np.ceil(np.sqrt(n) / 4))) for n, _ in sizes.values()], default=1)
    w = Window.partitionBy("season_index").orderBy(F.xxhash64("entity"), "entity")
    chosen: dict[int, list] = {}
    for r in points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per).collect():
        chosen.setdefault(r["season_index"], []).append(r["vec"])
    return {i: Cells(np.unique(np.array(v), axis=0), block) for i, v in chosen.items()}


def _of_index(batch: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    for index, rows in batch.groupby("season_index", sort=False):
        yield index, rows, np.stack(rows["vec"].to_numpy())


def assign(points: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """Points with the cell of their nearest pivot and their distance to it."""
    shared = points.sparkSession.sparkContext.broadcast(cells)     # checked in choose_pivots

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for index, rows, vec in _of_index(batch):
                d = shared.value[index].distances(vec)
                own = d.argmin(axis=1)
                yield rows.assign(cell=own.astype(np.int32), r=d[np.arange(len(d)), own])

    kind = points.schema
    return points.mapInPandas(near, f"entity {kind['entity'].dataType.simpleString()}, period "
                              f"{kind['period'].dataType.simpleString()}, season_index long, vec array<double>, "
                              "cell int, r double")


def with_bounds(cells: dict[int, Cells], members: DataFrame) -> dict[int, Cells]:
    """Cells with the number, least and greatest pivot distance of their members."""
    for c in cells.values():
        n = len(c.pivots)
        c.count, c.nearest, c.farthest = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        c.apart = c.distances(c.pivots)
    for r in members.groupBy("season_index", "cell").agg(
            F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect():   # one row per cell
        c = cells[r["season_index"]]
        c.count[r["cell"]], c.nearest[r["cell"]], c.farthest[r["cell"]] = r["n"], r["lo"], r["hi"]
    return cells


def visits(queries: DataFrame, cells: dict[int, Cells], k: int) -> DataFrame:
    """One row per query and block to visit. Queries without ``limit`` visit the
    first cells that hold more than k careers; with one, the other cells whose
    bound does not exceed it."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)    # checked in choose_pivots
    again = "limit" in queries.columns

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for index, rows, vec in _of_index(batch):
                c = shared.value[index]
                blocks = c.blocks()
                d = c.distances(vec)
                bounds = c.lower_bounds(d)
                go = c.first_visits(bounds, d, k + 1)
                if again:
                    limit = rows["limit"].to_numpy()
                    go = ~go & (bounds <= (limit * (1 + SLACK) + SLACK)[:, None])
                which, cell = np.nonzero(go)
                times = blocks[cell]
                which, cell = np.repeat(which, times), np.repeat(cell, times)
                first = np.cumsum(times) - times
                block = np.arange(len(cell)) - np.repeat(first, times)
                out = rows.iloc[which]
                part = out["spread"].to_numpy() % blocks[out["cell"].to_numpy()]
                yield pd.DataFrame({
                    "season_index": index, "cell": cell.astype(np.int32), "block": block.astype(np.int32),
                    "near": c.query_group(out["cell"].to_numpy()), "part": part.astype(np.int32), "name": out["entity"].to_numpy(),
                    "year": out["period"].to_numpy(), "vec": out["vec"].to_numpy(), "to_pivot": d[which, cell],
                    "limit": out["limit"].to_numpy() if again else np.full(len(out), np.inf)})

    key, period = (queries.schema[c].dataType.simpleString() for c in ("entity", "period"))
    spread = queries.withColumn("spread", F.pmod(F.xxhash64("entity", F.lit("query")), F.lit(1 << 30)))
    return spread.mapInPandas(plan, "season_index long, cell int, block int, near int, part int, "
                              f"name {key}, year {period}, vec array<double>, to_pivot double, limit double")


def nearest_in_group(asked: pd.DataFrame, members: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest members of each query of one group, ties by entity."""
    out = []
    if len(asked) and len(members):
        members = members.sort_values("r", kind="stable")
        r, vec = members["r"].to_numpy(), np.stack(members["vec"].to_numpy())
        entity = members["entity"].to_numpy()
        for q in asked.itertuples(index=False):
            reach = q.limit * (1 + SLACK) + SLACK
            a, b = np.searchsorted(r, q.to_pivot - reach), np.searchsorted(r, q.to_pivot + reach, "right")
            d = ((vec[a:b] - q.vec) ** 2).sum(axis=1)
            other = entity[a:b]
            fit = np.flatnonzero(other != q.name)
            if len(fit) > k:
                fit = fit[d[fit] <= np.partition(d[fit], k - 1)[k - 1]]
            best = sorted(zip(d[fit].tolist(), other[fit].tolist()))[:k]
            out += [(q.season_index, q.year, q.name, o, x) for x, o in best]
    return pd.DataFrame(out, columns=["season_index", "year", "name", "other", "d2"])


def compare(asked: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(season_index, year, name, other, d2): k rows per query and group."""
    key, period = (asked.schema[c].dataType.simpleString() for c in ("name", "year"))
    other = [f"to_{c}" for c in GROUP]
    wanted = asked.select(*[F.col(c).alias(o) for c, o in zip(GROUP, other)]).distinct()
    held = ["season_index", "cell", "block"]
    sent = members.select(*held, "entity", "vec", "r").join(
        wanted, [F.col(c) == F.col(f"to_{c}") for c in held]).select("entity", "vec", "r", *other)
    return asked.groupBy(*GROUP).cogroup(sent.groupBy(*other)).applyInPandas(
        lambda a, b: nearest_in_group(a, b, k),
        f"season_index long, year {period}, name {key}, other {key}, d2 double")


def nearest_careers(players: DataFrame, spec: SeasonSpec, targets: DataFrame, k: int = 5,
                    pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """experience (season index), year (the target's), name, similar_player,
    similarity_score, rank: the ``k`` most similar careers (all, if fewer) of
    every entity in ``targets`` at every index that both have reached. Ties go
    to the smaller key. Runs jobs: points, cells and first distances are written
    to scratch tables of the current scope."""
    ship_package(players.sparkSession)
    points = cut_lineage(career_points(players, spec), "careers")
    cells = choose_pivots(points, pivots, block)
    members = cut_lineage(assign(points, cells), "career-cells")
    cells = with_bounds(cells, members)
    sizes = members.groupBy("season_index", "cell").agg(F.ceil(F.count("*") / block).alias("blocks"))
    members = members.join(F.broadcast(sizes), ["season_index", "cell"]).withColumn(     # one row per cell
        "block", F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int"))
    ask = targets.select(F.col(spec.entity).alias("entity")).distinct()
    queries = members.select("entity", "period", "season_index", "vec", "cell").join(ask, "entity", "left_semi")
    queries = cut_lineage(queries, "career-queries")
    for r in queries.groupBy("season_index").count().collect():             # one row per index
        cells[r["season_index"]].asked = r["count"]

    first = cut_lineage(compare(visits(queries, cells, k), members, k), "first-visits")
    order = Window.partitionBy("season_index", "name").orderBy("d2", "other")
    bound = (first.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k)
             .select("season_index", F.col("name").alias("entity"), F.sqrt("d2").alias("limit")))
    bounded = queries.join(bound, ["season_index", "entity"], "left").withColumn(
        "limit", F.coalesce("limit", F.lit(float("inf"))))
    rest = compare(visits(bounded, cells, k), members, k)
    length = F.lit(float(len(spec.measures))) * (F.col("season_index") + 1)
    return (first.unionByName(rest).withColumn("rank", F.row_number().over(order).cast("bigint"))
            .where(F.col("rank") <= k)
            .select(F.col("season_index").alias("experience"), "year", "name", F.col("other").alias("similar_player"),
                    F.sqrt(F.col("d2") / length).alias("similarity_score"), "rank"))
