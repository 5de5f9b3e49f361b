"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

One permutation spreads the shingles over a universe of 2^32 positions, a
second one, circularly shifted by k, gives the k-th coordinate of the
signature: h_k = min over x of pi((sigma(x) + k) mod 2^32). ``BANDS`` bands of
``ROWS`` coordinates bucket the signatures; a pair at the threshold misses all
bands with probability (1 - 0.75^4)^32 = 5e-6.

Documents with equal shingle sets are one representative from the start (a
map-side minimum), so groups of exact copies are never paired. In a bucket the
members are compared with one hub, not with each other, and what agrees on the
full sets (100 * intersection >= 75 * union) is linked. Buckets that still
hold several components get other hubs (``HUB_ROUNDS``), and at the end every
member outside a bucket's largest component is compared with all members of
its other components, block by block: no candidate pair is dropped, only pairs
already connected are not compared again, and only links leave a block.

Defined results: null, empty and word-less texts have n_shingles 0 and are
their own component; rows with a null id get a null component; rows that
repeat an id are one document; empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_written, table, written
from .graph import components
from .shingles import Shingler, mix64

BANDS, ROWS, HUB_ROUNDS, BLOCK = 32, 4, 2, 512
PERCENT = 75
_SIGMA = np.uint64(0xD1B54A32D192ED03)


def _pi(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 2^32 positions, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of a non-empty set of 64-bit shingles."""
    at = (mix64(shingles ^ _SIGMA) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(coordinates, dtype=np.uint32)[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(at), 2048):
        np.minimum(out, _pi(at[None, i:i + 2048] + shift).min(axis=1), out=out)
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(rows, bands) 64-bit bucket keys of (rows, coordinates) signatures."""
    parts = signatures.reshape(len(signatures), bands, signatures.shape[1] // bands).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(parts.shape[2]):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands): the set's size, a 128-bit
    digest of it and its bucket keys (none for an empty set)."""

    @F.pandas_udf("n_shingles long, set_a long, set_b long, bands array<long>")
    def sign(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in texts:
            sets = [shingler(t) for t in batch]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = band_keys(np.array([signature(sets[i]) for i in full], np.uint32).reshape(-1, BANDS * ROWS))
            bands: list = [[]] * len(sets)
            for i, k in zip(full, keys):
                bands[i] = k
            digest = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            yield pd.DataFrame({
                "n_shingles": [len(s) for s in sets],
                "set_a": np.array([d >> 64 for d in digest], np.uint64).view(np.int64),
                "set_b": np.array([d & (2**64 - 1) for d in digest], np.uint64).view(np.int64),
                "bands": bands})

    return docs.select("doc_id", sign(F.col("text")).alias("s")).select("doc_id", "s.*")


def verified(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of ids whose full shingle sets reach the threshold."""

    @F.pandas_udf("boolean")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        shingler, last, left = Shingler(), None, None
        for ids, one, other in batches:
            out = []
            for i, x, y in zip(ids, one, other):
                if i != last:           # rows come sorted by the hub mostly
                    last, left = i, shingler(x)
                right = shingler(y)
                both = len(np.intersect1d(left, right, assume_unique=True))
                out.append(both > 0 and 100 * both >= percent * (len(left) + len(right) - both))
            yield pd.Series(out, dtype=bool)

    got = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    got = got.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return got.where(similar("a", "text_a", "text_b")).select("a", "b")


def _sized(cond_a: str, cond_b: str):
    """Jaccard cannot reach the threshold if the sizes are further apart."""
    return ((F.col(cond_a) * 100 >= F.col(cond_b) * PERCENT) & (F.col(cond_b) * 100 >= F.col(cond_a) * PERCENT))


def _with_component(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("component", F.col("id"))
    return (members.join(labels, "id", "left")
            .withColumn("component", F.coalesce("component", "id")))


def _hub_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Each member with its bucket's hub, where their components differ."""
    order = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
    me = F.struct("id", "n_shingles", "component")
    hubs = members.groupBy("bucket").agg(
        F.min_by(me, order).alias("hub"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    hubs = hubs.where("lo <> hi").select("bucket", F.col("hub.id").alias("hub"), F.col("hub.n_shingles").alias("hub_n"),
                                         F.col("hub.component").alias("hub_component"))
    got = members.join(hubs, "bucket").where("component <> hub_component").where(_sized("n_shingles", "hub_n"))
    return got.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(id, shingles): sorted 64-bit shingles as bytes."""

    @F.pandas_udf("binary")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingler = Shingler()
        for batch in batches:
            yield pd.Series([shingler(t).tobytes() for t in batch], dtype=object)

    return texts.select(F.col("doc_id").alias("id"), sets("text").alias("shingles"))


def stray_links(left: pd.DataFrame, right: pd.DataFrame, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links of the strays among ``left`` with rows of ``right`` in other
    components: one (the smallest id) per stray and component."""
    left = left[left["stray"]]
    if not len(left) or not len(right):
        return []
    sets = [np.frombuffer(b, np.uint64) for b in right["shingles"]]
    sizes = np.array([len(x) for x in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ids, parts, out = right["id"].to_numpy(), right["component"].to_numpy(), []
    mark = np.zeros(len(values), np.int32)
    for i, part, b in zip(left["id"], left["component"], left["shingles"]):
        mine = np.frombuffer(b, np.uint64)
        found = np.searchsorted(values, mine)
        found = found[found < len(values)]
        found = found[np.isin(values[found], mine, assume_unique=True)]
        mark[found] = 1
        both = np.add.reduceat(mark[at], starts)
        mark[found] = 0
        near = np.flatnonzero((100 * both >= percent * (sizes + len(mine) - both)) & (parts != part))
        for c in np.unique(parts[near]):
            j = ids[near[parts[near] == c]].min()
            out.append((min(i, j), max(i, j)))
    return out


def _rest_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links across the components that still share a bucket: every member
    outside the bucket's largest component is compared with all the bucket's
    members, block by block on the full sets. Only links leave a block."""
    per = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = per.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"),
                                     F.count("*").alias("parts"), F.sum("n").alias("n")).where("parts > 1")
    main = main.select("bucket", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(main, "bucket")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.select("bucket", "id", "component", "blocks", mine.alias("mine"),
                       (F.col("component") != F.col("main")).alias("stray"))
    rows = written(rows, "rest")
    ids = rows.select("id").distinct()
    wanted = texts.join(broadcast_if_small(ids, ids.count(), 48), texts["doc_id"] == ids["id"], "left_semi")
    sets = written(shingle_sets(wanted.dropDuplicates(["doc_id"])), "rest-sets")
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "mine",
                       "id", "component", "stray").join(sets, "id")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        i, j = g["i"].iloc[0], g["j"].iloc[0]
        if not g["stray"].any():
            return pd.DataFrame({"a": [], "b": []})
        left, right = g[g["mine"] == i], g[g["mine"] == j]
        out = stray_links(left, right)
        if i != j:
            out += stray_links(right, left)
        return pd.DataFrame(out, columns=["a", "b"])

    return rows.groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def _joined(links: DataFrame | None, found: DataFrame, labels: DataFrame | None):
    """The links with those found, and the components of all."""
    if found.isEmpty():
        return links, labels
    links = found if links is None else links.unionByName(found)
    return links, components(links)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    texts = docs.select("doc_id", "text")
    signed = written(signatures(texts), "signatures")
    reps = (signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b")
            .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"),
                 F.first("bands").alias("bands")))
    reps = written(reps, "representatives")
    rows = reps.select("id", "n_shingles", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = written(rows.join(shared, "bucket"), "buckets")

    labels, links, tested = None, None, None
    for turn in range(HUB_ROUNDS):
        pairs = _hub_pairs(_with_component(members, labels), turn)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        found = written(verified(pairs, texts), "found")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links, labels = _joined(links, found, labels)
    now = _with_component(members, labels)
    found = written(_rest_links(now, texts), "found")
    _, labels = _joined(links, found, labels)
    drop_written(members)

    of_set = reps.select("set_a", "set_b", F.col("id"))
    of_set = _with_component(of_set, labels).select("set_a", "set_b", F.col("component").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(of_set, ["set_a", "set_b"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id") == own).alias("kept"))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group (its smallest id); rows
    without an id stay. All columns are kept."""
    judged = written(near_duplicates(docs), "near-duplicates")
    kept = judged.where("kept").select("doc_id")
    n, ids = kept.agg(F.count("*"), F.count_distinct("doc_id")).first()
    out = docs.join(broadcast_if_small(kept.distinct(), ids, 48), "doc_id", "left_semi")
    if n != ids:            # rows that repeat an id are one document
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.where("doc_id IS NULL"))


def op4_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
