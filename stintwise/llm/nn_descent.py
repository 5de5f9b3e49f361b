"""Near-duplicate vectors by NN-descent.

A neighbour graph is started from vectors next to each other in the order of
random hyperplane codes (several orders), each vector keeping its best
``LIST`` neighbours of at least ``FLOOR`` similarity. Rounds join neighbours
of neighbours (links of both directions, at least one of them new), keep what
is better, and double the list of every vector whose list is saturated, that
is full of neighbours at the threshold. A bounded audit compares the result
with brute force, node by node, once over all nodes and once over those outside
the largest component, which a hot group would hide; the orders are doubled
until it holds. Where the orders' windows would compare as much as all pairs,
all pairs are compared block by block instead.

Threshold edges give the components. Lists that stayed saturated are enlarged
to their whole component: its members are compared block by block and only
counts leave a block, so the number of links is exact within a component and
no group of copies becomes a table of pairs. Equal vectors are one node with a
weight from the start.

Defined results: vectors that are null, zero, hold null or non-finite
components or have another length than the longest link with nothing and are
their own component; repeated ids are rows of their own that share the
smallest id; rows with a null id have null component and kept; an empty table
gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, table, written
from .graph import components
from .vectors import matrix, packed, usable_rows

THRESHOLD, FLOOR = 0.9, 0.5
LIST, WINDOW, ROUNDS, BITS = 12, 6, 5, 62
AUDIT, RECALL, BLOCK = 256, 0.98, 1024
#: Similarity and chance of a miss for which the number of orders is laid out.
DESIGN_COS, DESIGN_MISS = THRESHOLD, 0.01


def order_count(n: int) -> int:
    """Orders needed so that a pair of ``DESIGN_COS`` meets within ``WINDOW``
    places in one of them: it must share about log2(n / WINDOW) code bits."""
    same = 1 - np.arccos(DESIGN_COS) / np.pi
    together = same ** max(np.log2(max(n, 2) / WINDOW), 1)
    return int(np.ceil(np.log(DESIGN_MISS) / np.log(1 - min(together, 0.99))))


def ordered_pairs(nodes: DataFrame, orders: range, d: int) -> DataFrame:
    """(a, b, cos) of vectors within ``WINDOW`` places in each of the orders."""
    bits = BITS

    @F.pandas_udf("array<long>")
    def codes(u: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes = [np.random.default_rng(1000 + t).normal(size=(d, bits)) for t in orders]
        weight = (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
        for batch in u:
            x = packed(batch)
            yield pd.Series(list(np.column_stack([((x @ p) > 0) @ weight for p in planes])))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for b in batches:
            if tail is not None:
                b = pd.concat([tail, b], ignore_index=True)
            if len(b) < 2:
                tail = b
                continue
            x, ids, order = packed(b["u"]), b["id"].to_numpy(), b["order"].to_numpy()
            for k in range(1, min(WINDOW, len(b) - 1) + 1):
                s = np.einsum("ij,ij->i", x[:-k], x[k:])
                ok = (s >= FLOOR) & (order[:-k] == order[k:])
                yield pd.DataFrame({"a": np.minimum(ids[:-k], ids[k:])[ok], "b": np.maximum(ids[:-k], ids[k:])[ok],
                                    "cos": s[ok]})
            tail = b.iloc[-WINDOW:]

    rows = nodes.select("id", "u", F.posexplode(codes("u")).alias("order", "code"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartitionByRange(parts, "order", "code", "id").sortWithinPartitions("order", "code", "id")
    pairs = rows.mapInPandas(near, "a long, b long, cos double")
    return pairs.groupBy("a", "b").agg(F.max("cos").alias("cos"))


def cosines(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, cos) of pairs (a, b)."""

    @F.pandas_udf("double")
    def dot(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.einsum("ij,ij->i", packed(x), packed(y)) if len(x) else [], dtype=float)

    got = pairs.join(nodes.select(F.col("id").alias("a"), F.col("u").alias("ua")), "a")
    got = got.join(nodes.select(F.col("id").alias("b"), F.col("u").alias("ub")), "b")
    return got.select("a", "b", dot("ua", "ub").alias("cos"))


def best_lists(pairs: DataFrame, room: DataFrame | None) -> DataFrame:
    """(v, nb, cos, fresh): each node's best neighbours, as many as its room."""
    both = pairs.select(F.col("a").alias("v"), F.col("b").alias("nb"), "cos", "fresh").unionByName(
        pairs.select(F.col("b").alias("v"), F.col("a").alias("nb"), "cos", "fresh"))
    if room is None:
        both = both.withColumn("room", F.lit(LIST))
    else:
        both = both.join(room, "v", "left").withColumn("room", F.coalesce("room", F.lit(LIST)))
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("cos"), "nb"))
    return both.withColumn("r", rank).where("r <= room").drop("r")


def descent(pairs: DataFrame, nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Refined (a, b, cos): every pair whose similarity was found to reach the
    threshold, and the lists' other neighbours."""
    known = written(pairs.withColumn("fresh", F.lit(True)), "graph")
    room = None
    for _ in range(rounds):
        lists = written(best_lists(known, room), "lists")
        full = lists.groupBy("v").agg(F.count("*").alias("n"), F.min("cos").alias("low"), F.max("room").alias("room"))
        new_room = written(full.select("v", F.when((F.col("n") >= F.col("room")) & (F.col("low") >= THRESHOLD),
                                                   F.col("room") * 2).otherwise(F.col("room")).alias("room")), "room")
        one = lists.select("v", F.col("nb").alias("x"), F.col("fresh").alias("fx"))
        two = lists.select("v", F.col("nb").alias("y"), F.col("fresh").alias("fy"))
        tried = one.join(two, "v").where("x < y AND (fx OR fy)").select(F.col("x").alias("a"), F.col("y").alias("b"))
        tried = tried.distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
        found = written(cosines(tried, nodes).where(F.col("cos") >= FLOOR), "found")
        news = found.count()
        kept = lists.select(F.least("v", "nb").alias("a"), F.greatest("v", "nb").alias("b"), "cos").distinct()
        strong = known.where(F.col("cos") >= THRESHOLD).select("a", "b", "cos")
        old = kept.unionByName(strong).distinct().withColumn("fresh", F.lit(False))
        size = known.count()
        now = written(old.unionByName(found.withColumn("fresh", F.lit(True))), "graph")
        drop_written(known, lists, found)
        if room is not None:
            drop_written(room)
        known, room = now, new_room
        if news <= 0.001 * size:
            break
    return known.select("a", "b", "cos")


def audit(nodes: DataFrame, labels: DataFrame) -> float:
    """Share of audit nodes with true links whose every link lies in their
    component: the lower one of ``AUDIT`` of all nodes and of ``AUDIT`` nodes
    outside the largest component."""
    at = nodes.select("id", "u").join(labels.select("id", "component"), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    largest = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").first()
    outside = at.where(F.col("component") != largest["component"]) if largest else at
    groups = [g.orderBy(F.xxhash64("id", F.lit("audit")), "id").limit(AUDIT).collect() for g in (at, outside)]
    few = list({r["id"]: r for g in groups for r in g}.values())
    if not few:
        return 1.0
    ids, own = np.array([r["id"] for r in few]), np.array([r["component"] for r in few])
    x = packed([r["u"] for r in few])

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        true, same = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for b in batches:
            if len(b):
                hit = (x @ packed(b["u"]).T >= THRESHOLD) & (ids[:, None] != b["id"].to_numpy()[None, :])
                true += hit.sum(axis=1)
                same += (hit & (own[:, None] == b["component"].to_numpy()[None, :])).sum(axis=1)
        yield pd.DataFrame({"id": ids, "links": true, "same": same})

    got = at.mapInPandas(links, "id long, links long, same long").groupBy("id").agg(
        F.sum("links").alias("links"), F.sum("same").alias("same")).where("links > 0").collect()
    whole = {r["id"]: r["links"] == r["same"] for r in got}
    shares = [[whole[r["id"]] for r in g if r["id"] in whole] for g in groups]
    return min((float(np.mean(g)) for g in shares if g), default=1.0)


def all_links(nodes: DataFrame, n: int, size: int = 2 * BLOCK) -> DataFrame:
    """(a, b) that join every two nodes at the threshold, over a path of such
    pairs: all are compared block by block, and a block pair emits each node
    with the smallest one it reaches there."""
    blocks = -(-n // size)
    rows = nodes.select("id", "u", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("mine"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "id", "u")

    def join(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        x, ids = packed(g["u"]), g["id"].to_numpy()
        low = np.arange(len(ids))
        i, j = np.nonzero(x @ x.T >= THRESHOLD)
        while True:
            now = low.copy()
            np.minimum.at(now, i, low[j])
            now = now[now]
            if (now == low).all():
                break
            low = now
        other = low != np.arange(len(ids))
        return pd.DataFrame({"a": ids[low[other]], "b": ids[other]})

    return rows.groupBy("i", "j").applyInPandas(join, "a long, b long").distinct()


def links_within(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, n_links): weights of the other nodes of a component at the
    threshold, compared block by block; a block pair emits one count a node."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    blocks = sizes.select("component", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = nodes.join(labels, "id").join(blocks, "component")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a node goes to the group of (its block, every block)
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "mine",
                       "id", "u", "weight")

    def count(g: pd.DataFrame) -> pd.DataFrame:
        i, j = g["i"].iloc[0], g["j"].iloc[0]
        left, right = g[g["mine"] == i], g[g["mine"] == j]
        x, y = packed(left["u"]) if len(left) else None, packed(right["u"]) if len(right) else None
        if x is None or y is None:
            return pd.DataFrame({"id": [], "n_links": []})
        hit = (x @ y.T >= THRESHOLD) & (left["id"].to_numpy()[:, None] != right["id"].to_numpy()[None, :])
        out = [pd.DataFrame({"id": left["id"], "n_links": hit @ right["weight"].to_numpy()})]
        if i != j:
            out.append(pd.DataFrame({"id": right["id"], "n_links": hit.T @ left["weight"].to_numpy()}))
        return pd.concat(out)

    got = rows.groupBy("component", "i", "j").applyInPandas(count, "id long, n_links long")
    return got.groupBy("id").agg(F.sum("n_links").alias("n_links"))


def near_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows, d, n = usable_rows(vectors.select(F.col(key).alias("id"), F.col(column).alias("v")).where("id IS NOT NULL"), "v")

    @F.pandas_udf("binary")
    def unit(v: pd.Series) -> pd.Series:
        x = matrix(v)
        x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
        return pd.Series([r.tobytes() for r in x / np.linalg.norm(x, axis=1, keepdims=True)] if len(x) else [],
                         dtype=object)

    everyone = vectors.select(F.col(key).alias("id"))
    own = F.coalesce("component_id", "id")
    if not n:
        out = everyone.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("id")})
        return out.select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    members = written(rows.select("id", unit("v").alias("u")), "units")
    nodes = members.groupBy("u").agg(F.min("id").alias("id"), F.count_distinct("id").alias("weight"))
    nodes = written(nodes.groupBy("id").agg(F.min("u").alias("u"), F.max("weight").alias("weight")), "nodes")

    done, known, orders = 0, None, order_count(n)
    while True:
        pairs = ordered_pairs(nodes, range(done, done + orders), d)
        done += orders
        if known is not None:
            pairs = pairs.unionByName(known).groupBy("a", "b").agg(F.max("cos").alias("cos"))
        known = descent(pairs, nodes)
        labels = components(known.where(F.col("cos") >= THRESHOLD))
        if audit(nodes, labels) >= RECALL:
            break
        if 2 * done * WINDOW >= n:
            labels = components(written(all_links(nodes, n), "all-links"))
            break
        orders = done
    links = links_within(nodes, labels)
    of_node = nodes.select("u", F.col("id").alias("node"), "weight")
    per = members.join(of_node, "u").join(labels.withColumnRenamed("id", "node"), "node", "left")
    per = per.join(links.withColumnRenamed("id", "node"), "node", "left").groupBy("id").agg(
        F.max(F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.min(F.coalesce("component", "node")).alias("component_id"))
    out = everyone.join(per, "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      own.alias("component_id"), (F.col("id") == own).alias("kept"))


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
