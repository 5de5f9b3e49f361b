"""Benchmark decontamination by one Aho-Corasick automaton.

Every benchmark item (questions and answers alike) is normalised to its terms
and cut into windows of ``WINDOW`` consecutive terms; an item of fewer, but not
none, is one window. The windows go into one automaton over term numbers, and
every document's terms run through it once; a match marks the terms that it
covers. Marked term ranges are mapped to offsets of the original text, so the
caller can cut or mask the passage as it was written.

Scale: documents are scanned where they lie, without a shuffle. The automaton
is the only thing sent to tasks. Windows are grouped by Spark; an automaton
holds ``AUTOMATON_WINDOWS`` of them at most (about 50 MB a worker), and
beyond that the next automaton scans the written result of the one before,
adding its matches, so neither the driver nor a worker ever holds more.

Defined results: a null or empty text has no terms and no match; a document
without terms has empty arrays; a null item id marks passages but is not listed;
an item id of several rows has the windows of each row and is listed once;
repeated documents are scanned each; no items, or none with terms: nothing is
marked; no documents: no row. An input column named ``overlap`` is replaced;
all others stay as they are.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, table, written
from .terms import PATTERN, term_spans, terms_column, terms_of

WINDOW = 10
AUTOMATON_WINDOWS = 100_000
OVERLAP = ("n_terms long, ranges array<struct<first:long,last:long>>, "
           "spans array<struct<start:long,end:long>>, items array<string>")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window array<string>, items array<string>): each distinct window of the
    items once, with the ids of the items that hold it."""
    terms = items.select(F.col("item_id").cast("string").alias("item"), terms_column(F.col("text")).alias("terms"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("terms") - (window - 1), F.lit(1)))
    cut = (terms.where(F.size("terms") > 0).select("item", "terms", F.explode(starts).alias("at"))
           .select("item", F.slice("terms", F.col("at"), F.lit(window)).alias("window")))
    return cut.groupBy("window").agg(F.collect_set("item").alias("items"))


class Scanner:
    """An automaton over the windows of one block, built once per worker."""

    def __init__(self, windows: list[tuple[list[str], list[str]]]):
        self.windows, self.automaton = windows, None

    def __getstate__(self):
        return self.windows

    def __setstate__(self, state):
        self.windows, self.automaton = state, None

    def build(self) -> Scanner:
        if self.automaton is None:
            self.number: dict[bytes, int] = {}
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for i, (words, _) in enumerate(self.windows):
                # 0 is a term of no window
                key = tuple([self.number.setdefault(w.encode(), len(self.number) + 1) for w in words])
                self.automaton.add_word(key, (i, len(key)))
            self.automaton.make_automaton()
        return self

    def matches(self, terms: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """(first, last) term of every match, and the ids of the items matched."""
        get = self.number.get
        found = [(end - n + 1, end, i) for end, (i, n) in self.automaton.iter(tuple([get(t, 0) for t in terms]))]
        ids = {x for i in {f[2] for f in found} for x in self.windows[i][1]}
        return np.array([f[:2] for f in found], np.int64).reshape(-1, 2), ids


def merged_ranges(found: np.ndarray) -> list[tuple[int, int]]:
    """Matched ranges as disjoint ones that do not touch, in order."""
    if not len(found):
        return []
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    reach = np.maximum.accumulate(found[:, 1])
    new = np.append(True, found[1:, 0] > reach[:-1] + 1)
    last = np.append(reach[:-1][new[1:]], reach[-1])
    return [(int(a), int(b)) for a, b in zip(found[new, 0], last)]


def _overlap(scanner: Scanner, text: str | None, before) -> tuple:
    terms = terms_of(text)
    found, ids = scanner.matches(terms) if terms and scanner.windows else (np.empty((0, 2), np.int64), set())
    if before is not None:
        found = np.vstack([found, np.array([(r["first"], r["last"]) for r in before["ranges"]], np.int64).reshape(-1, 2)])
        ids = ids.union(before["items"])
    ranges = merged_ranges(found)
    spans = []
    if ranges:
        at = term_spans(text)
        spans = [{"start": at[a][0], "end": at[b][1]} for a, b in ranges]
    return len(terms), [{"first": a, "last": b} for a, b in ranges], spans, sorted(ids)


def scanned(docs: DataFrame, scanner: Scanner, again: bool) -> DataFrame:
    """``docs`` with ``overlap``; ``again``: added to what it holds already."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner)   # at most AUTOMATON_WINDOWS windows
    names = ["n_terms", "ranges", "spans", "items"]

    @F.pandas_udf(OVERLAP)
    def first(texts: pd.Series) -> pd.DataFrame:
        one = shared.value.build()
        return pd.DataFrame([_overlap(one, t, None) for t in texts], columns=names)

    @F.pandas_udf(OVERLAP)
    def more(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        one = shared.value.build()
        return pd.DataFrame([_overlap(one, t, b) for t, b in zip(texts, before.to_dict("records"))], columns=names)

    return docs.withColumn("overlap", more(F.col("text"), F.col("overlap")) if again else first(F.col("text")))


def find_overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                  most: int = AUTOMATON_WINDOWS) -> DataFrame:
    """``docs`` (with a ``text``) and, as ``overlap``, what they share with
    ``items`` (item_id, text): number of terms, marked term ranges, their spans
    in the original text, and the items, sorted as strings."""
    windows = written(item_windows(items, window), "windows")
    blocks = max(1, -(-windows.count() // most))
    for block in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        scanner = Scanner([(r["window"], r["items"]) for r in part.toLocalIterator()])
        docs = scanned(docs, scanner, again=block > 0)
        if block < blocks - 1:
            docs = written(docs, "overlaps")
    drop_written(windows)
    return docs


def masked(docs: DataFrame, mask: str = "") -> DataFrame:
    """``docs`` with every marked span of the text replaced by ``mask``."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, marked in zip(texts, spans):
            for s in reversed(marked if text is not None else []):
                text = text[:s["start"]] + mask + text[s["end"]:]
            out.append(text)
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", cut(F.col("text"), F.col("overlap.spans")))


def op13_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = find_overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "overlap.*")
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return got.select("doc_id", F.col("n_terms").alias("n_words"), n_hit.alias("n_hit"),
                      F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{PATTERN}') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{PATTERN}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
place AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
found AS (
  SELECT a.rid, a.i, win.k, win.item_id
  FROM (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM place CROSS JOIN sizes WHERE i + k - 1 <= len(w)) a
  JOIN win ON win.k = a.k AND win.s = a.s),
hit AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM found) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""
