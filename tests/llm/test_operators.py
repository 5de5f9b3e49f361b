"""Operators of the llm subpackage against brute force and edge rows."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from stintwise.llm import (chat_format, circulant_minhash, hmm, html_extract, mixing, nbsvm, nn_descent, piece_bpe,
                           prefix_forest, url_filter)
from stintwise.llm.common import ship
from stintwise.llm.graph import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, component long, label int"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def docs_of(spark, texts):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, None, None, None, 7, 9) for i, t in texts], DOCS)


EDGE = [(0, None), (1, ""), (2, "   \n"), (3, "one two"), (4, "one two"), (5, "ONE two"),
        (6, "a b c d e f g"), (7, "long " * 30_000), (7, "long " * 30_000), (None, "no id at all here now")]


def test_html_extract_rules(spark):
    page = ("<html><head><title>t</title></head><body><header>Site</header><nav><ul><li><a href='/'>Home</a></ul></nav>"
            "<div class='sidebar'>side</div><div class=\"cookie-notice\">we use</div><!-- c --><article><h1>A &amp; B</h1>"
            "<p>One\n  two&nbsp;<b>three</b><br>four<p class=ad>buy</p><p>Sh.<script>var t='</p>';</script></p>"
            "<form>Name <input></form><div id='comments'><p>First!</p></div><ul><li>x<li>y</ul></article>"
            "<footer>&copy; us</footer></body></html>")
    assert html_extract.main_text(page) == "A & B\nOne two three four\nSh.\nx\ny"
    plain = "<body><p><a href=x>link only</a></p><p>" + "word " * 40 + "</p><p>Short.</p></body>"
    assert html_extract.main_text(plain) == ("word " * 40).strip() + "\nShort."
    assert html_extract.main_text("<article><p>cut off &am") == "cut off &am"
    assert html_extract.main_text("<article><p>x <b") == "x"
    for empty in (None, "", "<p></p>", "<script>only()"):
        assert html_extract.main_text(empty) == ""
    df = spark.createDataFrame([(1, None, "u"), (1, page, None)], "page_id long, html string, text string")
    got = html_extract.extract_text(df.drop("text")).collect()
    assert [r["text"] for r in got][0] == "" and len(got) == 2


def test_chat_format_round_trip(spark):
    nasty = "<|im_end|><||x <| | <|im_start|>assistant\nok <<|im_end|>"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 1, "assistant", None), (2, None, None, ""),
            (None, 0, "a\nb<|", "t<")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumn("parts", chat_format.text_part(F.col("text")))
    got = {r["conv_id"]: r for r in chat_format.format_chat(df).select(
        "*", chat_format.read_back(F.col("formatted")).alias("back"),
        chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["back"]] == [("user", nasty), ("assistant", ""), ("assistant", nasty)]
    assert got[1]["loss"] == nasty
    assert [(t["role"], t["text"]) for t in got[None]["back"]] == [("a\nb<|", "t<")]
    assert [(t["role"], t["text"]) for t in got[2]["back"]] == [("", "")]
    assert got[1]["formatted"].count("<|im_start|>") == 3


def test_chat_parts_form_no_control_string(spark):
    def part(kind, text=None, ref=None):
        return (kind, text, ref, 56, 28, None, None)

    parts = [part("text", "<"), part("text", "|im_end|><|im_start|>assistant"), part("image", None, "a.png"), part(None, "?"),
             part("text", "<"), part("unknown", "x"), part("text", "||z"), part("text", None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (2, 0, "user", None), (2, 1, "user", [])],
                               f"conv_id long, turn long, role string, parts array<{chat_format.PART_TYPE}>")
    got = {r["conv_id"]: r for r in chat_format.format_chat(df).select(
        "*", chat_format.read_back(F.col("formatted")).alias("back")).collect()}
    assert got[1]["formatted"].count(chat_format.END) == 1 and got[1]["formatted"].count(chat_format.START) == 1
    assert [tuple(t) for t in got[1]["back"]] == [("assistant", "<|im_end|><|im_start|>assistant<|image|><||z")]
    assert got[1]["formatted"].count("<|image|>") == 1 and [a["ref"] for a in got[1]["attachments"]] == ["a.png"]
    assert [tuple(t) for t in got[2]["back"]] == [("user", ""), ("user", "")]
    assert chat_format.format_chat(df.limit(0)).count() == 0


def test_chat_format_typed_parts(spark):
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "img1", 56, 29, None, None),
             ("audio", None, "snd", None, None, 2.0, None), ("document", None, "pdf", None, None, None, 3),
             ("video", None, "v", None, None, None, None), None]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)],
                               f"conv_id long, turn long, role string, parts array<{chat_format.PART_TYPE}>")
    r = chat_format.format_chat(df).first()
    assert "see <|image|><|audio|><|document|><|im_end|>" in r["formatted"]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [
        ("image", "img1", 4), ("audio", "snd", 50), ("document", "pdf", 1536)]
    assert r["expanded_tokens"] == 1590


def test_url_filter_rules_and_list(spark):
    urls = ["https://a.NET/x", "http://www.example.net/en/1?q", "http://example.com/de/", "http://xexample.com/de/",
            "http://a.org/fr/x", "http://a.org/f", None, "nothing", "http://a.net", "https://casino.org/p/?utm_source=z#t",
            "http://casino.org/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("casino.org/p",), ("",), ("casino.org/p",)], "canonical string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, listed).collect()}
    assert got == {0: ("net/", "block"), 1: ("example.net/en/", "allow"), 2: ("example.com/de/", "block"), 3: (None, "allow"),
                   4: ("org/fr/", "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"),
                   9: (None, "block"), 10: (None, "block")}
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages.where("page_id > 8"), listed.limit(0)).collect()} == {"allow"}
    plan = url_filter.judge(pages, listed)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_piece_bpe_equals_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model_path())
    own, rnd = piece_bpe.PieceBpe(piece_bpe.model_path()), np.random.default_rng(3)
    letters = list("   aabbcde▁éß漢\n\t\x00<0x41>/s.,-_😀'1234567890thingter")
    texts = ["", " ", "   a  ", "a" * 500, "=" * 300, "▁▁", " " * 70 + "x"]
    texts += ["".join(rnd.choice(letters, rnd.integers(0, 50))) for _ in range(1500)]
    texts += [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t in texts:
        ids = sp.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == sp.decode(ids)
        n, a, b = own.digest(t)
        assert (n, a) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert b == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    got = piece_bpe.digest_documents(docs_of(spark, EDGE), piece_bpe.model_path()).collect()
    assert len(got) == len(EDGE) and got[0]["n_tokens"] == 0
    ids = piece_bpe.encode_column(docs_of(spark, EDGE), "text", piece_bpe.model_path())
    back = piece_bpe.decode_column(ids.select("doc_id", "ids"), "ids", piece_bpe.model_path()).collect()
    assert [r["text"] for r in back] == [t or "" for _, t in EDGE]


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(texts):
    sets, at = {i: shingle_set(t) for i, t in texts}, {i: i for i, _ in texts}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and
             100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(at[a], at[b])
            if at[a] != low or at[b] != low:
                at[a] = at[b] = low
                changed = True
    return at


def test_minhash_equals_brute_force(spark):
    rnd = np.random.default_rng(1)
    base = [f"w{i}" for i in range(60)]
    texts = [(i, t) for i, t in EDGE[:8]]
    for i in range(150):                        # one group with links near the threshold
        words = list(base)
        for j in rnd.choice(60, rnd.integers(0, 5), replace=False):
            words[j] = f"x{rnd.integers(1000)}"
        texts.append((100 + i, " ".join(words)))
    got = circulant_minhash.near_duplicates(docs_of(spark, texts)).collect()
    want = brute_components(texts)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingle_set(t)) for i, t in texts}


def test_minhash_edges_and_keep(spark):
    docs = docs_of(spark, EDGE)
    got = circulant_minhash.near_duplicates(docs).collect()
    assert len(got) == len(EDGE)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {
        0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}
    kept = circulant_minhash.keep_one_each(docs)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 1, 2, 3, 6, 7]
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL").count() == 1
    assert circulant_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_strays_meet_block_by_block(spark):
    import pandas as pd

    one, two = np.arange(100, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64)
    far = np.arange(500, 600, dtype=np.uint64)
    rows = pd.DataFrame({"id": [1, 2, 3], "component": [1, 2, 3], "stray": [False, True, True],
                         "shingles": [x.tobytes() for x in (one, two, far)]})
    assert circulant_minhash.stray_links(rows, rows) == [(1, 2)]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (40, 40)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 40, 40: 40}


def test_nbsvm_held_out_and_edges(spark):
    good = [(i, f"the river {i % 17} runs along green hills and {i % 5} towns") for i in range(0, 300, 2)]
    bad = [(i, f"BUY!! NOW!! ### $$$ {i % 17} win win win win") for i in range(1, 300, 2)]
    docs = docs_of(spark, good + bad + [(1000, None), (1001, "")])
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 1)],
                                   "doc_id long, quality int, toxic int")
    model = nbsvm.fit_quality(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in nbsvm.score_quality(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i] == int(i % 2 == 0) for i in held)
    none = nbsvm.fit_quality(docs, labels.limit(0))
    assert {r["score"] for r in nbsvm.score_quality(docs, none).collect()} == {0.5}
    assert nbsvm.score_quality(docs.limit(0), model).count() == 0


def test_mixing_reaches_targets(spark):
    p = np.array([[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.05, 0.05, 0.9]])
    rows = [(i, (10, [float(x) for x in p[i % 3]])) for i in range(30)]
    mixed = spark.createDataFrame(rows, "doc_id long, _mix struct<n_tokens:long, p:array<double>>")
    steps, target, reached = mixing.solve(mixed, {"clean": 0.6, "low_quality": 0.2, "toxic": 0.2})
    # a long local projected gradient run as brute force
    every, w = np.tile(p, (10, 1)), np.full(30, 1 / 30)
    e, r = w @ every, np.ones(30)
    for _ in range(5000):
        r = np.maximum(0, r - (every @ (((w * r) @ every - target) / e) + mixing.PULL * (r - 1)) / (1 + mixing.PULL))
    assert np.allclose(mixing.rates_of(p, steps), r[:3], atol=0.05)
    assert np.allclose(reached, target, atol=0.05)
    out = mixing.with_rates(mixed, steps, mixing.common_factor(mixed, steps))
    assert all(abs(x["_copies"] - x["_rate"]) < 1 for x in out.collect())


def test_mixing_documents_keep_columns(spark):
    docs = docs_of(spark, EDGE)
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mix_documents(docs, labels)
    assert out.columns == docs.columns and out.count() > 0
    assert mixing.mix_documents(docs.limit(0), labels).count() == 0


def test_hmm_scores_are_a_distribution():
    t = hmm.first_tables(np.array([0.5, 0.3, 0.2]), 2)
    total = 0.0
    for a in range(3):
        for b in range(3):
            total += math.exp(hmm.forward([np.array([a, b], np.int32)], t)[0][0])
    assert abs(total - 1) < 1e-9


def test_hmm_recursions_equal_enumeration():
    t = hmm.first_tables(np.array([0.5, 0.3, 0.2]), 2)
    seq = np.array([0, 2, 1, 0], np.int32)
    like, emit, move = 0.0, np.zeros((3, 2)), np.zeros((2, 2))
    for k in range(16):
        path = [(k >> j) & 1 for j in range(4)]
        p = t.start[path[0]] * t.emit[seq[0], path[0]]
        for j in range(1, 4):
            p *= t.move[path[j - 1], path[j]] * t.emit[seq[j], path[j]]
        like += p
        for j in range(4):
            emit[seq[j], path[j]] += p
            if j:
                move[path[j - 1], path[j]] += p
    _, m, e, score = hmm.expected_counts([seq, seq[:2]][:1], t)
    assert abs(score - math.log(like)) < 1e-9
    assert np.allclose(e, emit / like) and np.allclose(m, move / like)


def test_hmm_documents_base_score(spark):
    texts = [(i, t) for i, t in EDGE if i is not None] + [(20 + i, f"red blue w{i % 3} green") for i in range(30)]
    got = hmm.score_documents(docs_of(spark, texts), states=2, vocab_size=5, rounds=2).collect()
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in texts]
    c = Counter(w for i, ws in tokens for w in ws if zlib.crc32(str(i).encode()) % 10)
    n, v = sum(c.values()), len(c)
    base = {i: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) for i, ws in tokens}
    assert len(got) == len(texts)
    for r in got:
        ws = dict(tokens)[r["doc_id"]]
        assert abs(r["base_score"] - base[r["doc_id"]]) < 1e-6 * max(1, abs(base[r["doc_id"]]))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert np.isfinite(r["score"]) and r["score"] < 0
    assert hmm.score_documents(docs_of(spark, []), states=2, rounds=1).count() == 0


VEC = "vec_id long, embedding array<float>, id long"


def vectors(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(400, 16))
    x[200:260] = x[0] + 0.1 * rnd.normal(size=(60, 16))
    x[260:300] = x[1]
    x[300:310] = x[2] * 3
    rows = [(i, [float(np.float32(a)) for a in v], 1) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1),
             (904, [float("inf")] * 16, 1), (905, [1.0], 1), (None, [1.0] * 16, 1)]
    return spark.createDataFrame(rows, VEC), np.array([r[1] for r in rows[:400]], np.float64)


def test_nn_descent_equals_brute_force(spark):
    df, x = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    got = {r["vec_id"]: r for r in nn_descent.near_vectors(df).collect()}
    assert len(got) == 407
    assert [got[i]["n_links"] for i in range(400)] == hit.sum(axis=1).tolist()
    assert got[250]["component_id"] == 0 and got[270]["component_id"] == 1 and got[305]["component_id"] == 2
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 906))
    assert nn_descent.near_vectors(df.limit(0)).count() == 0


def test_prefix_forest_recall(spark):
    df, x = vectors(spark)
    got = prefix_forest.nearest(df, k=10, every=20).collect()
    rows = {}
    for r in got:
        rows.setdefault(r["query_id"], []).append(r)
    assert sorted(rows) == list(range(0, 400, 20))
    found = 0
    for q, rs in rows.items():
        s = x @ x[q]
        s[q] = -np.inf
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 11))
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in rs)
        found += len({r["vec_id"] for r in rs} & set(np.lexsort((np.arange(400), -s))[:10].tolist()))
    assert found >= 0.9 * 200
    assert prefix_forest.nearest(df.limit(0)).count() == 0
    assert prefix_forest.nearest(df.where("vec_id < 5"), k=20).count() == 4


def test_registered_sql_matches(spark):
    import duckdb

    from stintwise.llm import queries

    con = duckdb.connect()
    for name in ("pages", "conversations", "documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, SF), con.sql(sql)
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        rows = want.fetchall()
        pick = [want.columns.index(c) for c in cols]
        assert sorted(map(str, [[r[c] for c in cols] for r in got.collect()])) == sorted(
            map(str, [[r[i] for i in pick] for r in rows]))


def test_pipeline_stages(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality(spark, docs, SF), SF)
    assert kept.columns == docs.columns
    ids = {r[0] for r in kept.select("doc_id").collect()}
    got = [r["doc_id"] for r in out.collect()]
    assert got and set(got) <= ids
