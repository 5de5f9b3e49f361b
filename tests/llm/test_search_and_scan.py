"""Shared-query search, periodic runs and decontamination against brute force
and edge rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from stintwise.llm import decontaminate, periodic_runs, shared_queries
from stintwise.llm.common import ship
from stintwise.llm.queries import QUERIES
from stintwise.llm.terms import term_spans, terms_of

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HOSTILE = ["", "   ", "İSTANBUL Straße ß Ä", "a-b_c@d[e`f{g\x7fh\x80i", "one\x00two\x1cthree four five", "É1é2 ３"]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def test_terms_and_their_spans():
    for text in HOSTILE:
        got = [t.decode() for t in terms_of(text)]
        assert got == terms(text)
        assert [text[a:b].translate(LOWER) for a, b in term_spans(text)] == got
    assert terms_of(None) == []


# ---- shared queries

def ranked(docs, items, k=10):
    """By definition: item -> [(doc_id, score)]."""
    words = [(i, terms(t)) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, length = len(words), sum(len(w) for _, w in words)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(terms(t))
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = {}
    for item, query in queries.items():
        scores = []
        for i, w in words:
            m = 10 + 90 * len(w) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m))
                    for t in query if t in df and t in w)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        if scores:
            out[item] = [(i, -s) for s, _, _, i in sorted(scores, key=lambda r: r[:3])[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


def test_mined_sums_are_the_plain_sums():
    rnd = random.Random(3)
    common = [list(range(40)), list(range(20, 60))]
    lists = [sorted(set(rnd.sample(common[i % 2], 25)) | {100 + i, 101 + i}) for i in range(60)] + [[5], [5], [7, 8], [7, 8]]
    dag = shared_queries.mine(lists, 200)
    assert dag.additions() < sum(len(one) - 1 for one in lists)
    assert any(len(level) for level in dag.levels[1:])          # sums of sums
    leaves = np.random.default_rng(1).integers(0, 1 << 40, (200, 9))
    parts = np.zeros((dag.nodes, 9), np.int64)
    parts[:200] = leaves
    assert (dag.totals(parts) == np.stack([leaves[one].sum(axis=0) for one in lists])).all()
    serves = {}                                                 # every node serves several items
    children = {int(n): (int(x), int(y)) for level in dag.levels for n, x, y in level}
    for i, one in enumerate(dag.lists):
        stack = list(one)
        while stack:
            n = stack.pop()
            serves.setdefault(n, set()).add(i)
            stack += children.get(n, ())
    assert all(len(serves[n]) > 1 for n in children)


def test_rank_documents_by_definition(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "99"]
    docs = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 60)))) for i in range(150)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)]         # copies: ties by id
    docs += [(7, docs[7][1]), (None, docs[7][1]), (500, None), (501, ""), (502, " .,- "), (503, "w1 " * 50_000)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=12)) + " unseen") for i in range(30)]
    items += [(0, "W3, w4"), (None, docs[7][1]), (90, None), (91, "..."), (92, "nowhere")]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item int, rank int").repartition(5)
    q = spark.createDataFrame([(*r, 1.0) for r in items], "item_id long, text string, score double")
    want = ranked(docs, items)
    assert found(shared_queries.rank_documents(d, q)) == want
    assert found(shared_queries.rank_documents(d, q, most=7)) == want      # several blocks of items
    assert found(shared_queries.rank_documents(d.limit(0), q)) == {}
    assert found(shared_queries.rank_documents(d, q.limit(0))) == {}


def test_rank_parts_do_not_depend_on_step(spark, monkeypatch):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    q = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = ranked([tuple(r) for r in d.collect()], [tuple(r) for r in q.collect()])
    assert found(QUERIES["op11_shared_queries"](spark, SF)) == want
    plan = shared_queries.plan_block([{"terms": ["a"]}])
    best = shared_queries.Best(1, 2)
    for score, doc in [(5, 9), (5, 3), (0, 1), (5, 7), (6, 8)]:
        best.offer(np.array([[score]]), np.array([doc]))
    assert best.score.tolist() == [[6, 5]] and best.doc.tolist() == [[8, 3]] and plan.dag.additions() == 0


# ---- periodic runs

def smallest_period(w):
    return next(p for p in range(1, len(w) + 1) if all(w[i] == w[i - p] for i in range(p, len(w))))


def runs_by_definition(w, shortest=12):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        for s in range(len(w) - 2 * q + 1):
            if s and w[s - 1] == w[s - 1 + q]:
                continue                                        # the word before extends it
            e = s + q
            while e < len(w) and w[e] == w[e - q]:
                e += 1
            if e - s >= max(shortest, 2 * q) and smallest_period(w[s:e]) == q:
                out.add((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rnd, n, letters, repeats):
    w = [b"%d" % rnd.randrange(letters) for _ in range(n)]
    for _ in range(repeats):
        a, p = rnd.randrange(n), 1 + rnd.randrange(max(1, n // 3))
        for i in range(a + p, min(n, a + rnd.randrange(1, n + 1))):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize("dense", [64, 4, 8])
def test_runs_by_definition(monkeypatch, dense):
    monkeypatch.setattr(periodic_runs, "DENSE", dense)          # small: the block ranks do most lags
    rnd = random.Random(dense)
    for _ in range(250):
        w = periodic(rnd, rnd.randint(1, 110), rnd.choice([1, 2, 3, 5, 40]), rnd.randint(0, 4))
        assert periodic_runs.runs_of(w) == runs_by_definition(w)
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 140:
        a, b = b, b + a
    assert periodic_runs.runs_of(b) == runs_by_definition(b)


def test_long_runs_and_very_long_texts():
    rnd = random.Random(2)
    block = [b"%d" % rnd.randrange(400) for _ in range(3000)]
    w = [b"x"] + block * 3 + block[:77] + [b"y"]
    assert [r for r in periodic_runs.runs_of(w) if r[2] > 64] == [(1, 9077, 3000)]
    assert periodic_runs.runs_of([b"long"] * 300_000) == [(0, 300_000, 1)]
    assert periodic_runs.runs_of(([b"a"] * 5000 + [b"b"]) * 2)[:2] == [(0, 5000, 1), (0, 10002, 5001)]
    assert periodic_runs.runs_of([]) == [] and periodic_runs.runs_of([b"a"] * 11) == []


def test_find_runs_edges(spark):
    rows = [(1, None), (1, ""), (2, "a b " * 6 + "c"), (2, "a b " * 6 + "c"), (3, "A b c " * 12), (4, "one\ttwo\x0bthree\x1cfour")]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, runs int, n_runs string")
    got = [(r["n_runs"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.find_runs(df).collect()]
    assert got == [("z", [], ""), ("z", [], ""), ("z", [(0, 12, 2)], "a b c"), ("z", [(0, 12, 2)], "a b c"),
                   ("z", [(0, 12, 1)], "A b c"), ("z", [], "one two three\x1cfour")]
    assert periodic_runs.find_runs(df.limit(0)).count() == 0


def test_op12_by_definition(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, b" ".join(periodic(rnd, rnd.randint(1, 90), rnd.choice([2, 3, 60]), rnd.randint(0, 2))).decode()) for i in range(120)]
    rows += [(None, "a " * 20), (33, None), (33, ""), (44, "B b " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    planted = 0
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            planted += 1
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs = runs_by_definition(w)
        drop = {j for s, n, q in runs for j in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        text_of = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(x for j, x in enumerate(w) if j not in drop)
        want = (len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                hashlib.sha256(text_of.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
        assert want in got[i]
    assert planted > 5 and sum(map(len, got.values())) == len(rows)


# ---- decontamination

def overlaps_by_definition(text, items, window=10):
    w, hit, ids = terms(text), set(), set()
    for item, t in items:
        words = terms(t)
        k = min(len(words), window)
        for s in range(len(words) - k + 1 if words else 0):
            for i in range(len(w) - k + 1):
                if w[i:i + k] == words[s:s + k]:
                    hit.update(range(i, i + k))
                    ids.update([str(item)] if item is not None else [])
    return len(w), hit, sorted(ids)


@pytest.mark.parametrize("most", [100_000, 5])
def test_overlaps_by_definition(spark, most):
    rnd = random.Random(4)
    vocabulary = list("abcdef") + ["Über", "x1"]
    say = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    items = [(i, say(rnd.choice([2, 3, 9, 10, 11, 25]))) for i in range(12)]
    items += [(3, "q"), (100, None), (101, " - "), (None, "null id"), (11, items[4][1]), (12, items[4][1])]
    docs = [(i, say(rnd.randint(1, 40))) for i in range(40)]
    docs += [(i, say(5) + "; " + (t or "").upper().replace(" ", "\n- ") + " " + say(4)) for i, t in items if i is not None]
    docs += [(200, None), (201, ""), (202, "Q!"), (202, "Q!"), (None, "(null) ID"), (203, "a " * 30_000), (204, "aq qa")]
    d = spark.createDataFrame([(*r, 5, [1]) for r in docs], "doc_id long, text string, items int, n_words array<int>")
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, window string")
    out = decontaminate.find_overlaps(d, q, most=most)
    rows = out.collect()
    assert len(rows) == len(docs) and {"items", "n_words", "overlap"} < set(out.columns)
    for r in rows:
        if r["doc_id"] == 203:
            assert r["overlap"]["n_terms"] == 30_000
            continue
        n, hit, ids = overlaps_by_definition(r["text"], items)
        o = r["overlap"]
        assert (o["n_terms"], o["items"]) == (n, ids)
        assert {i for x in o["ranges"] for i in range(x["first"], x["last"] + 1)} == hit
        assert [" ".join(terms(r["text"][s["start"]:s["end"]])) for s in o["spans"]] == [
            " ".join(terms(r["text"])[x["first"]:x["last"] + 1]) for x in o["ranges"]]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.masked(out.where("doc_id >= 200 OR doc_id IS NULL"), "_").collect()}
    assert cut[200] is None and cut[202] == "_!" and cut[None] == "(_" and cut[204] == "aq qa"
    assert decontaminate.find_overlaps(d.limit(0), q).count() == 0
    assert {(len(r["overlap"]["items"]), len(r["overlap"]["ranges"])) for r in
            decontaminate.find_overlaps(d, q.limit(0)).collect()} == {(0, 0)}


def test_op13_digests(spark, tmp_path):
    items = [(2, "one two three"), (10, "two three"), (7, "nothing here")]
    docs = [(1, "ONE, two: three!"), (2, None), (3, "three two")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_aho_corasick"](spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (3, 3, 2, sha("10,2"), True), 2: (0, 0, 0, sha(""), False), 3: (2, 0, 0, sha(""), False)}
