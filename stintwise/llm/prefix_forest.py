"""Approximate nearest neighbours by a hash-prefix forest (largest inner product).

Each of ``TREES`` trees gives every vector a string of ``BITS`` bits, the sides
of random planes (orthogonal in turns of the dimension). A tree is the sorted
array of its strings; the strings that begin with a prefix are one run of it.
*Descent*: binary searches in the arrays give the length of each run that a
query's prefixes reach. The arrays are searched ``STEP`` bits at a time: the
first bits of a tree are a directory of 2^STEP counts, and below it only the
cells asked by queries that may stop there are opened, each a sorted array of
at most 2^STEP counts, down to the last bit. *Ascent*: from the longest matches
up, all trees together a bit at a time, and within the last bit tree by tree,
until the runs hold at least ``min_candidates`` entries; their rows are scored.
At the root a run holds every row, so a query that finds too few ends with an
exact search.

``min_candidates`` is not fixed: a bounded set of audit queries is searched by
brute force, and the smallest value of a growing series is taken at which the
runs hold ``RECALL`` of their true neighbours, so recall does not depend on
the size of the table. Inner products become angles by one more coordinate
(sqrt(max norm^2 - norm^2) for rows, 0 for queries).

A run is split into blocks of ``ITEMS`` rows and ``QUERIES`` queries, so a hot
prefix (or the root) spreads over as many groups as it needs. A block scores
the original vectors in double precision and gives the k best of every query
by score, then id; equal vectors of a block are one node with its ids in
order. The k best of a query's blocks are thus the k best of all its runs hold.

Defined results: vectors that are null, zero, hold null or non-finite
components or have another length than the longest take no part; fewer
candidates than k give fewer rows; ties go to the smaller id; rows that repeat
an id are one candidate; empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_written, table, written
from .vectors import matrix, packed, usable_rows

TREES, BITS, STEP = 56, 60, 12
RECALL, AUDIT, GROWTH = 0.95, 96, 1.25
ITEMS, QUERIES, CELLS = 8192, 2048, 64
_RESULT = "query_id long, rank int, vec_id long, score double"


def planes(d: int, trees: int, seed: int = 5) -> np.ndarray:
    """(d, trees * BITS) normals, in orthogonal groups of up to d within a tree."""
    random, turns = np.random.default_rng(seed), -(-BITS // d)
    one = [np.hstack([np.linalg.qr(random.normal(size=(d, d)))[0] for _ in range(turns)])[:, :BITS] for _ in range(trees)]
    return np.hstack(one).astype(np.float32)


def hash_strings(x: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """(rows, trees) strings as integers, the first bit highest."""
    bits = np.zeros((len(x), normals.shape[1] // BITS, 64), bool)
    bits[:, :, 64 - BITS:] = (x.astype(np.float32) @ normals > 0).reshape(len(x), -1, BITS)
    return np.packbits(bits, axis=2).view(">i8")[:, :, 0].astype(np.int64)


def common_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of strings."""
    differ, out = a ^ b, np.full(np.broadcast(a, b).shape, BITS)
    for k in range(BITS):
        out -= (differ >> k) > 0
    return out


def run_lengths(cells: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """(asked, STEP): entries of the sorted array ``cells`` that share 1, 2, ...
    STEP leading bits with each asked cell, by binary search."""
    below = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty((len(asked), STEP), np.int64)
    for bits in range(1, STEP + 1):
        low = asked >> (STEP - bits) << (STEP - bits)
        out[:, bits - 1] = (below[np.searchsorted(cells, low + (1 << (STEP - bits)))] - below[np.searchsorted(cells, low)])
    return out


def lengths_of(held: bytes, trees: int) -> np.ndarray:
    """(trees, depths known) run lengths from a query's packed ones."""
    return np.frombuffer(held, np.int64).reshape(-1, trees, STEP).transpose(1, 0, 2).reshape(trees, -1)


def ascent(lengths: np.ndarray, need: int) -> np.ndarray:
    """The depth at which a query stops in each tree, -1 where it asks nothing.

    All trees go up to the last depth whose runs hold ``need`` entries, but the
    last bit only as many trees, in order, as it takes. If no depth holds
    enough, the first tree goes to the root."""
    trees, known = lengths.shape
    total = lengths.sum(axis=0)
    depth = int((total >= need).sum())           # totals never grow with the depth
    if depth == 0:
        return np.where(np.arange(trees) == 0, 0, -1)
    at = np.full(trees, depth)
    if depth < known:
        up = total[depth] + np.cumsum(lengths[:, depth - 1] - lengths[:, depth])
        at[np.searchsorted(up, need) + 1:] = depth + 1
    return np.where(lengths[np.arange(trees), at - 1] > 0, at, -1)


def block_best(x: np.ndarray, ids: np.ndarray, node: np.ndarray, y: np.ndarray, asked: np.ndarray,
               k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of the k best rows of every query, by score,
    then id. ``x`` has one vector a node, ``node`` the node of each row of ``ids``."""
    order = np.lexsort((ids, node))
    ids, node = ids[order], node[order]
    size = np.bincount(node, minlength=len(x))
    first = np.cumsum(size) - size
    size = np.minimum(size, k + 1)          # one of them may be the query itself
    d, out = x.shape[1], []
    long = np.linalg.norm(x, axis=1).max()
    for i in range(0, len(y), 256):
        some = y[i:i + 256]
        s = some @ x.T
        m = min(k + 1, s.shape[1])
        low = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
        # a matrix product rounds by position: what its error can hide is summed once more, the same way everywhere
        low = low - 4 * d * np.finfo(np.float64).eps * long * np.linalg.norm(some, axis=1)
        q, at = np.nonzero(s >= low[:, None])
        step = max(1, (1 << 22) // d)
        score = np.concatenate([(x[at[j:j + step]] * some[q[j:j + step]]).sum(axis=1) for j in range(0, len(q), step)])
        each = size[at]
        start = np.cumsum(each) - each
        row = np.repeat(first[at] - start, each) + np.arange(each.sum())
        q, got, score = np.repeat(q, each), ids[row], np.repeat(score, each)
        other = got != asked[i + q]
        q, got, score = q[other], got[other], score[other]
        order = np.lexsort((got, -score, q))
        q, got, score = q[order], got[order], score[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < k
        out.append((asked[i + q[best]], got[best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


class Forest:
    """Search over ``rows`` (id, v: array); built lazily by Spark."""

    def __init__(self, rows: DataFrame, d: int, n: int, trees: int = TREES):
        self.spark, self.n, self.trees = rows.sparkSession, n, trees
        self.normals = normals = self.spark.sparkContext.broadcast(planes(d + 1, trees))
        norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        top = rows.agg(F.max(norm2)).first()[0]
        self.kind = kind = np.float32 if rows.schema["v"].dataType.elementType.typeName() == "float" else np.float64

        @F.pandas_udf("strings array<long>, vec binary")
        def encode(vs: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for v in vs:
                x = matrix(v)
                rest = np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))
                strings = hash_strings(np.column_stack([x, rest]), normals.value) if len(x) else []
                yield pd.DataFrame({"strings": list(strings), "vec": [r.tobytes() for r in x.astype(kind)]})

        self.rows = written(rows.select("id", encode(F.col("v")).alias("e")).select("id", "e.*"), "forest")

    def directory(self) -> np.ndarray:
        """(trees, 2^STEP) entries by the first bits: map-side counts, a bounded table."""
        at = self.rows.select(F.posexplode("strings").alias("tree", "string"))
        at = at.groupBy("tree", F.shiftright("string", BITS - STEP).alias("cell")).agg(F.count("*").alias("n")).toPandas()
        out = np.zeros((self.trees, 1 << STEP), np.int64)
        out[at["tree"], at["cell"]] = at["n"]
        return out

    def descended(self, queries: DataFrame, least: int) -> DataFrame:
        """(id, vec, strings, held): the queries' own strings and the lengths of
        the runs they reach, as deep as runs of ``least`` entries go."""
        trees, kind, normals = self.trees, self.kind, self.normals
        counts = self.spark.sparkContext.broadcast(self.directory())

        @F.pandas_udf("strings array<long>, held binary, deepest long")
        def first(vecs: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            cells = np.arange(1 << STEP)
            for v in vecs:
                x = packed(v, kind).astype(np.float64) if len(v) else np.empty((0, 1))
                codes = hash_strings(np.column_stack([x, np.zeros(len(x))]), normals.value) if len(x) else np.empty((0, trees), int)
                got = [run_lengths(cells, counts.value[t], codes[:, t] >> (BITS - STEP)) for t in range(trees)]
                got = np.stack(got, axis=1)
                yield pd.DataFrame({"strings": list(codes), "held": [g.tobytes() for g in got],
                                    "deepest": got[:, :, -1].sum(axis=1)})

        at = queries.select("id", "vec", first("vec").alias("e")).select("id", "vec", "e.*")
        at = written(at, "descent")
        for base in range(STEP, BITS, STEP):
            if at.where(F.col("deepest") >= least).isEmpty():
                break
            deeper = self.opened(at.where(F.col("deepest") >= least), base)
            now = at.withColumnRenamed("deepest", "before").join(deeper, "id", "left").select(
                "id", "vec", "strings", F.expr("CASE WHEN more IS NULL THEN held ELSE concat(held, more) END").alias("held"),
                F.coalesce("deepest", F.lit(0)).alias("deepest"))
            now = written(now, "descent")
            drop_written(at)
            at = now
        return at

    def opened(self, queries: DataFrame, base: int) -> DataFrame:
        """(id, more, deepest): run lengths of the ``STEP`` bits after ``base``,
        from the cells of ``base`` bits that these queries are in."""
        def cell(bits: int) -> Column:
            return F.shiftright("string", BITS - bits)

        asks = queries.select("id", F.posexplode("strings").alias("tree", "string"))
        asks = asks.select("id", "tree", cell(base).alias("parent"), cell(base + STEP).alias("cell"))
        plan = asks.groupBy("tree", "parent").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
        plan = written(plan, "cells")
        cells = plan.count()
        small = broadcast_if_small(plan, cells, 64)
        key = ["tree", "parent"]
        # about CELLS cells of a tree are searched together, as one sorted array
        together = F.pmod(F.xxhash64("parent"), F.lit(-(-cells // (CELLS * self.trees)))).cast("int").alias("part")
        held = self.rows.select(F.posexplode("strings").alias("tree", "string"))
        held = held.select("tree", cell(base).alias("parent"), cell(base + STEP).alias("cell")).join(small, key)
        held = held.groupBy(*key, "blocks", "cell").agg(F.count("*").alias("n"))
        held = held.select("tree", together, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "cell", "n",
                           F.lit(None).cast("long").alias("id"))
        asks = asks.join(small, key).select("tree", together, F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"),
                                            "cell", F.lit(0).cast("long").alias("n"), "id")

        def search(g: pd.DataFrame) -> pd.DataFrame:
            ask = g["id"].notna().to_numpy()
            q, cells = g[ask], g[~ask].sort_values("cell")
            got = run_lengths(cells["cell"].to_numpy(), cells["n"].to_numpy(), q["cell"].to_numpy())
            return pd.DataFrame({"id": q["id"].astype("int64"), "tree": q["tree"], "more": [r.tobytes() for r in got],
                                 "deepest": got[:, -1]})

        got = held.unionByName(asks).groupBy("tree", "part", "block").applyInPandas(
            search, "id long, tree int, more binary, deepest long")
        got = got.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("tree", "more"))).alias("by_tree"),
                                    F.sum("deepest").alias("deepest"))
        more = F.aggregate("by_tree", F.lit(b""), lambda s, x: F.concat(s, x["more"]))
        return got.select("id", more.alias("more"), "deepest")

    def audit(self, asked: DataFrame, least: int, k: int) -> int:
        """The smallest candidate number at which the audit queries' runs hold
        ``RECALL`` of their true neighbours."""
        few = asked.orderBy(F.xxhash64("id", F.lit("audit")), "id").limit(AUDIT).collect()
        if not few:
            return least
        ids, kind = np.array([r["id"] for r in few]), self.kind
        x = packed([r["vec"] for r in few], kind).astype(np.float64)
        strings = np.array([r["strings"] for r in few], np.int64)

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                s = x @ packed(b["vec"], kind).astype(np.float64).T
                s[ids[:, None] == b["id"].to_numpy()[None, :]] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                codes = np.stack(b["strings"].to_numpy())
                q, at = np.repeat(np.arange(len(ids)), top.shape[1]), top.ravel()
                fit = np.isfinite(s[q, at])
                q, at = q[fit], at[fit]
                yield pd.DataFrame({"q": q, "score": s[q, at], "common": [
                    c.astype(np.int8).tobytes() for c in common_bits(codes[at], strings[q])]})

        found = self.rows.select("id", "vec", "strings").mapInPandas(best, "q int, score double, common binary")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
        true = found.withColumn("r", rank).where(F.col("r") <= k).select("q", "common").toPandas()
        if not len(true):
            return least
        common, of = packed(true["common"], np.int8), true["q"].to_numpy()
        lengths = [lengths_of(r["held"], self.trees) for r in few]
        need = least
        while need < self.n * self.trees:
            depth = np.stack([ascent(each, need) for each in lengths])[of]
            if ((common >= depth) & (depth >= 0)).any(axis=1).mean() >= RECALL:
                break
            need = int(need * GROWTH)
        return need

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, vec_id, score) of the k best rows found per query.
        ``queries`` are rows of the forest's table."""
        trees, n = self.trees, self.n
        least = trees * (k + 1)          # a row is at most once in each tree: at least k others
        descent = self.descended(queries, least)
        need = self.audit(descent, least, k)

        @F.pandas_udf("array<struct<depth:int,items:long>>")
        def stops(held: pd.Series) -> pd.Series:
            out = []
            for h in held:
                lengths = lengths_of(h, trees)
                out.append([{"depth": int(d), "items": n if d == 0 else int(lengths[t, d - 1]) if d > 0 else 0}
                            for t, d in enumerate(ascent(lengths, need))])
            return pd.Series(out, dtype=object)

        prefix = F.expr(f"shiftright(string, {BITS} - depth)").alias("prefix")
        asked = descent.select("id", "vec", "strings", F.posexplode(stops("held")).alias("tree", "stop"))
        asked = asked.where("stop.depth >= 0").select(
            "id", "vec", "tree", "stop.*", F.element_at("strings", F.col("tree") + 1).alias("string"))
        asked = written(asked.select("id", "vec", "tree", "depth", "items", prefix), "asked-runs")

        # how each asked run is split: blocks of rows by blocks of queries
        plan = asked.groupBy("tree", "depth", "prefix").agg(F.count("*").alias("asks"), F.max("items").alias("items"))
        plan = written(plan.select("tree", "depth", "prefix", F.ceil(F.col("items") / ITEMS).cast("int").alias("row_blocks"),
                                   F.ceil(F.col("asks") / QUERIES).cast("int").alias("query_blocks")), "run-blocks")
        small = broadcast_if_small(plan, plan.count(), 64)
        used = F.broadcast(plan.select("tree", "depth").distinct())      # at most TREES x (BITS + 1)
        key = ["tree", "depth", "prefix"]

        def block(c: str, blocks: str) -> Column:
            return F.pmod(F.xxhash64("id", F.lit(c)), F.col(blocks)).cast("int")

        def every(blocks: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

        items = self.rows.select("id", "vec", F.posexplode("strings").alias("tree", "string")).join(used, "tree")
        items = items.select("id", "vec", "tree", "depth", prefix)
        items = items.join(small, key).withColumns({"rb": block("row", "row_blocks"), "ask": F.lit(False)})
        items = items.withColumn("qb", every("query_blocks"))
        asks = asked.join(small, key).withColumns({"qb": block("query", "query_blocks"), "ask": F.lit(True)})
        asks = asks.withColumn("rb", every("row_blocks"))
        cols = [*key, "rb", "qb", "ask", "id", "vec"]

        kind = self.kind

        def score(block: pd.DataFrame) -> pd.DataFrame:
            ask = block["ask"].to_numpy()
            q, r = block[ask], block[~ask]
            if not len(q) or not len(r):
                return pd.DataFrame({"qid": [], "id": [], "score": []})
            node, vecs = pd.factorize(r["vec"].to_numpy())
            best = block_best(packed(vecs, kind).astype(np.float64), r["id"].to_numpy(), node,
                              packed(q["vec"], kind).astype(np.float64), q["id"].to_numpy(), k)
            return pd.DataFrame(dict(zip(("qid", "id", "score"), best)))

        near = items.select(*cols).unionByName(asks.select(*cols)).groupBy(*key, "rb", "qb").applyInPandas(
            score, "qid long, id long, score double")
        near = near.groupBy(F.col("qid").alias("query_id"), F.col("id").alias("vec_id")).agg(
            F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return near.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select(
            "query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k nearest rows of every row whose id is divisible by ``every``."""
    rows, d, n = usable_rows(vectors.where(F.col(key).isNotNull()), column)
    if not n:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v")).dropDuplicates(["id"])
    forest = Forest(rows, d, n)
    return forest.search(forest.rows.where(F.col("id") % every == 0), k)


def op6_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
