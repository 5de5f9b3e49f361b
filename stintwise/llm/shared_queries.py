"""Ranked lexical search of many queries at once over shared parts.

Scores are sums over a query's terms, so queries that have terms in common have
partial sums in common. ``mine`` looks for them: an item's terms, in the order
of how many items hold them, form a list, and neighbours that stand together in
several lists become one node (the sum of two), round by round, until no pair
occurs twice. The nodes and the rest lists are a DAG. For each document the impacts
of its terms fill the leaves, each shared node is summed once, level by level,
and every item adds up what is left of its list.

Scale: a block of at most ``ITEMS`` items is planned at once (terms and DAG go
to the driver and the tasks, bounded by the block). Documents are tokenised once
a block, where they lie; their counts of query terms are written, and document
frequencies are summed from that table. Scoring is one pass over it that keeps
the best ``k`` of every item per task, so the shuffle holds k rows an item and
task, whatever the number of matching documents.

Defined results: an item without terms has no row; an item id of several rows is
one item with the terms of all; a null item id is an item. A null or empty text
has no terms and counts in no statistic; repeated documents each have their
rank; equal scores go by ascending doc_id, null ids last (rows equal in both are
interchangeable); no documents or no items: no row. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, table, written
from .terms import PATTERN, terms_column, terms_of

TOP = 10
ITEMS = 4096
PARTS_BYTES = 32 << 20      # accumulators of the documents summed together
LAST = np.iinfo(np.int64).max


class Dag:
    """Sums shared by the items. Nodes below ``leaves`` are terms; level by
    level, ``pairs`` hold (node, left, right); ``lists[i]`` are the nodes whose
    sum is item i."""

    def __init__(self, leaves: int, levels: list[np.ndarray], lists: list[list[int]]):
        self.leaves, self.levels, self.lists = leaves, levels, lists
        self.nodes = leaves + sum(map(len, levels))
        self.flat = np.array([n for one in lists for n in one], np.int64)
        self.starts = np.cumsum([0] + [len(one) for one in lists[:-1]])

    def additions(self) -> int:
        """Additions a document costs, unshared lists costing one less than terms."""
        return sum(map(len, self.levels)) + len(self.flat) - len(self.lists)

    def totals(self, parts: np.ndarray) -> np.ndarray:
        """Item by document, from ``parts`` (node by document) with its leaves filled."""
        for level in self.levels:
            parts[level[:, 0]] = parts[level[:, 1]] + parts[level[:, 2]]
        return np.add.reduceat(parts[self.flat], self.starts, axis=0)


def mine(items: list[list[int]], leaves: int) -> Dag:
    """The DAG of shared sums for items given as non-empty lists of distinct terms."""
    lists, levels, nodes = [list(one) for one in items], [], leaves
    while True:
        holders = Counter(n for one in lists for n in one)
        # nodes of exactly the same items stand together: next to the number of
        # holders comes a number of the set of holders itself
        held: dict[int, int] = {}
        for i, one in enumerate(lists):
            for n in one:
                held[n] = hash((held.get(n, 0), i))
        for one in lists:
            one.sort(key=lambda n: (-holders[n], held[n], n))
        pairs = Counter(p for one in lists for p in zip(one, one[1:]))
        made: dict[tuple[int, int], int] = {}
        for one in lists:
            i, out = 0, []
            while i < len(one):
                pair = (one[i], one[i + 1]) if i + 1 < len(one) else None
                after = (one[i + 1], one[i + 2]) if i + 2 < len(one) else None
                if pair and pairs[pair] > 1 and pairs[pair] >= pairs.get(after, 0):
                    out.append(made.setdefault(pair, nodes + len(made)))
                    i += 2
                else:
                    out.append(one[i])
                    i += 1
            one[:] = out
        # a node that one item alone came to use is no shared one
        used = Counter(n for one in lists for n in one if n >= nodes)
        keep = {p: nodes + i for i, p in enumerate(p for p, n in made.items() if used[n] > 1)}
        back = {n: p for p, n in made.items()}
        for one in lists:
            one[:] = [m for n in one for m in (
                [n] if n < nodes else [keep[back[n]]] if back[n] in keep else back[n])]
        if not keep:
            return Dag(leaves, levels, lists)
        levels.append(np.array([(n, *p) for p, n in keep.items()], np.int64))
        nodes += len(keep)


class Plan:
    """What the tasks of one block need: terms with weights, and the DAG."""

    def __init__(self, terms: list[str], dag: Dag, weights: np.ndarray | None = None,
                 documents: int = 0, length: int = 0):
        self.terms, self.dag, self.weights = terms, dag, weights
        self.documents, self.length, self._number = documents, length, None

    @property
    def number(self) -> dict[bytes, int]:
        if self._number is None:
            self._number = {t.encode(): i for i, t in enumerate(self.terms)}
        return self._number

    def __getstate__(self):
        return {**self.__dict__, "_number": None}

    def weighted(self, documents: int, length: int, held: np.ndarray) -> Plan:
        w = np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * held + 1))).astype(np.int64)
        return Plan(self.terms, self.dag, w, documents, length)

    def impacts(self, n: np.ndarray, term: np.ndarray, tf: np.ndarray, doc: np.ndarray) -> np.ndarray:
        m = 10 + (90 * n * self.documents) // self.length
        return self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))


class Best:
    """The k best (score, document) of every item, score first, then small id."""

    def __init__(self, items: int, k: int):
        self.score = np.zeros((items, k), np.int64)
        self.doc = np.full((items, k), LAST)

    def offer(self, totals: np.ndarray, doc: np.ndarray) -> None:
        worst, last = self.score[:, -1:], self.doc[:, -1:]
        better = (totals > worst) | ((totals == worst) & (totals > 0) & (doc < last))
        for i in np.flatnonzero(better.any(axis=1)):
            at = np.flatnonzero(better[i])
            s, d = np.append(self.score[i], totals[i, at]), np.append(self.doc[i], doc[at])
            top = np.lexsort((d, -s))[:self.score.shape[1]]
            self.score[i], self.doc[i] = s[top], d[top]


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of every item that has any."""
    each = items.select("item_id", F.explode(F.array_distinct(terms_column(F.col("text")))).alias("term")).distinct()
    return each.groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def plan_block(rows: list) -> Plan:
    number: dict[str, int] = {}
    lists = [[number.setdefault(t, len(number)) for t in r["terms"]] for r in rows]
    return Plan(list(number), mine(lists, len(number)))


def query_term_counts(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, n, term array, tf array): terms in all, and the plan's terms with
    their occurrences, of every document that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast(plan)    # one block's terms and DAG

    @F.pandas_udf("n long, term array<int>, tf array<long>")
    def count(texts: pd.Series) -> pd.DataFrame:
        number, out = shared.value.number, []
        for text in texts:
            terms = terms_of(text)
            seen = Counter(terms)
            known = [t for t in seen if t in number]
            out.append((len(terms), [number[t] for t in known], [seen[t] for t in known]))
        return pd.DataFrame(out, columns=["n", "term", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), count(F.col("text")).alias("c")).select(
        "doc_id", "c.*").where("n > 0")


def best_of_tasks(counts: DataFrame, plan: Plan, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of every item in each task."""
    shared = counts.sparkSession.sparkContext.broadcast(plan)  # one block's terms, weights and DAG

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        dag, best = plan.dag, Best(len(plan.dag.lists), k)
        step = max(16, PARTS_BYTES // (8 * (dag.nodes + len(dag.flat))))
        for batch in batches:
            ids = batch["doc_id"].fill_null(LAST).to_numpy()
            n = batch["n"].to_numpy()
            sizes = batch["term"].value_lengths().to_numpy()
            term, tf = batch["term"].flatten().to_numpy(), batch["tf"].flatten().to_numpy()
            doc = np.repeat(np.arange(len(ids)), sizes)
            impact, ends = plan.impacts(n, term, tf, doc), np.cumsum(sizes)
            for a in range(0, len(ids), step):
                b = min(a + step, len(ids))
                row = slice(ends[a] - sizes[a], ends[b - 1])
                parts = np.zeros((dag.nodes, b - a), np.int64)
                parts[term[row], doc[row] - a] = impact[row]
                best.offer(dag.totals(parts), ids[a:b])
        item, place = np.nonzero(best.score)
        found = best.doc[item, place]
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(found, pa.int64(), mask=found == LAST),
             pa.array(best.score[item, place], pa.int64())], names=["item", "doc_id", "score"])

    return counts.mapInArrow(score, "item int, doc_id long, score long")


def ranked_block(docs: DataFrame, rows: list, id_type, k: int) -> DataFrame:
    """The k best documents of each item of one block."""
    spark, plan = docs.sparkSession, plan_block(rows)
    counts = written(query_term_counts(docs, plan), "query-terms")
    documents, length = counts.agg(F.count("*"), F.sum("n")).first()
    held = np.zeros(len(plan.terms), np.int64)
    for r in counts.select(F.explode("term").alias("term")).groupBy("term").count().toLocalIterator():
        held[r["term"]] = r["count"]
    plan = plan.weighted(documents, length or 1, held)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = (best_of_tasks(counts, plan, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {id_type}")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")     # ITEMS rows at most


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, most: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest documents (doc_id, text)
    for each of ``items`` (item_id, text)."""
    spark, id_type = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    queries = written(item_terms(items), "item-terms")
    blocks = -(-queries.count() // most)
    out = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        rows = sorted(part.toLocalIterator(), key=lambda r: (r["item_id"] is not None, r["item_id"]))
        if rows:
            out = out.unionByName(ranked_block(docs, rows, id_type, k))
    drop_written(queries)
    return out


def op11_shared_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{PATTERN}') AS w
  FROM documents),
d AS (SELECT rid, doc_id, len(w) AS n, w FROM words WHERE len(w) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS length FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{PATTERN}')) AS term
  FROM benchmark),
tf AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
score AS (
  SELECT q.item_id, d.rid, d.doc_id,
         CAST(sum(weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN weight USING (term) JOIN d USING (rid), total
  GROUP BY q.item_id, d.rid, d.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score,
             row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM score WHERE score > 0)
WHERE rank <= {TOP}
"""
