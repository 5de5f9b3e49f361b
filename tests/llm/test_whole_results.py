"""Results that caps, bounds or early ends once cut short, against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest

from stintwise.llm import hmm, html_extract, mixing, ngrams, nn_descent, prefix_forest
from stintwise.llm.common import ship
from stintwise.llm.graph import components


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.mark.parametrize("noise", [0.0, 1e-4])
def test_forest_among_many_equal_vectors(spark, noise):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(900, 16))
    x[100:700] = x[100] + noise * rnd.normal(size=(600, 16))
    x = x.astype(np.float32).astype(np.float64)
    ids = rnd.permutation(900)
    df = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x)],
                               "vec_id long, embedding array<float>")
    got = {}
    for r in prefix_forest.nearest(df, k=20, every=20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    hot = [at for at in range(100, 700) if ids[at] % 20 == 0]
    assert hot
    for at in hot:
        s = (x * x[at]).sum(axis=1)
        s[at] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]].tolist()
        assert [got[ids[at]][r] for r in range(1, 21)] == want


def hot_and_pairs(spark):
    """300 near copies and 40 pairs of cosine 0.91, as nodes."""
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(380, 32))
    x[:300] = x[0] + 1e-3 * rnd.normal(size=(300, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(300, 380, 2):
        side = x[i + 1] - (x[i + 1] @ x[i]) * x[i]
        x[i + 1] = 0.91 * x[i] + np.sqrt(1 - 0.91 ** 2) * side / np.linalg.norm(side)
    return spark.createDataFrame([(i, v.tobytes(), 1) for i, v in enumerate(x)], "id long, u binary, weight long")


def test_audit_sees_lost_pairs_beside_a_hot_group(spark):
    nodes = hot_and_pairs(spark)
    lost = spark.createDataFrame([(i, 0) for i in range(300)], "id long, component long")
    assert nn_descent.audit(nodes, lost) < nn_descent.RECALL
    found = lost.unionByName(spark.createDataFrame([(i, i // 2 * 2) for i in range(300, 380)], lost.schema))
    assert nn_descent.audit(nodes, found) == 1.0


def test_all_links_join_what_blocks_part(spark):
    got = components(nn_descent.all_links(hot_and_pairs(spark), 380, size=50)).collect()
    assert {r["id"]: r["component"] for r in got} == {i: 0 for i in range(300)} | {i: i // 2 * 2 for i in range(300, 380)}


def test_orders_are_laid_out_for_the_threshold():
    same = 1 - np.arccos(nn_descent.THRESHOLD) / np.pi
    n = 60_000
    miss = (1 - same ** np.log2(n / nn_descent.WINDOW)) ** nn_descent.order_count(n)
    assert miss <= nn_descent.DESIGN_MISS


def test_mixing_of_soft_posteriors_reaches_the_optimum(spark):
    rnd = np.random.default_rng(8)
    p = rnd.dirichlet([1.4, 0.4, 0.2], size=400)
    tokens = rnd.integers(1, 200, 400)
    rows = [(i, (int(n), [float(x) for x in v])) for i, (n, v) in enumerate(zip(tokens, p))]
    mixed = spark.createDataFrame(rows, "doc_id long, _mix struct<n_tokens:long, p:array<double>>")
    dual, target, reached = mixing.solve(mixed)
    # projected gradient steps until nothing moves
    w = tokens / tokens.sum()
    e, r = w @ p, np.ones(400)
    for _ in range(20_000):
        r = np.maximum(0, r - (p @ (((w * r) @ p - target) / e) + mixing.PULL * (r - 1)) / (1 + mixing.PULL))
    assert np.allclose(mixing.rates_of(p, dual), r, atol=1e-3)
    assert np.allclose(reached, (w * r) @ p, atol=1e-5)


def test_mixing_takes_few_projected_steps(spark):
    rnd = np.random.default_rng(9)
    p = np.vstack([rnd.dirichlet([0.1, 0.02, 0.01], size=300), [[1 / 3, 1 / 3, 1 / 3]]])
    rows = [(i, (int(n), [float(x) for x in v])) for i, (n, v) in enumerate(zip(rnd.integers(0, 200, 301), p))]
    mixed = spark.createDataFrame(rows, "doc_id long, _mix struct<n_tokens:long, p:array<double>>")
    steps, target, _ = mixing.solve(mixed, {"clean": 0.98, "low_quality": 0.01, "toxic": 0.01})
    assert 0 < len(steps) < 40
    last = steps[-1]
    assert all(s.share > 0 and s.length > 0 for s in steps)
    assert abs(mixing.rates_of(p, steps) - mixing.rates_of(p, steps[:-1])).max() < 1e-3
    assert (mixing.rates_of(p, steps) >= 0).all() and last.y.shape == (3,)
    assert mixing.solve(mixed.limit(0))[0] == []


def test_tokens_are_runs_of_one_class():
    want = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
    for text in (None, "", " ", "a", "A_b9 12,,x", "\n\x1c\u3000é² ١٢ 漢字!?\U0001f600\U000e0041__", "ABCD abcd Abcd " * 5, "x" * 70_000):
        number, start = ngrams.token_numbers(text or "")
        found = list(want.finditer(text or ""))
        assert start.tolist() == [m.start() for m in found]
        name = [(m[0].lower(), len(m[0]) > 3 and m[0].isupper()) for m in found]
        assert len(set(number.tolist())) == len(set(name)) == len(set(zip(name, number.tolist())))
    hasher, texts = ngrams.NgramHasher(), ["one two", None, "", "THREE four five", "y " * 200_000, "one two"]
    got = list(hasher.many(texts))
    assert [n for _, n in got] == [2, 0, 0, 3, 200_000, 2]
    assert all(np.array_equal(f, hasher(t)) for (f, _), t in zip(got, texts))
    assert len(got[0][0]) == 3 and len(got[1][0]) == 0


def test_html_wrappers_and_teasers_keep_the_article():
    text = "word " * 40
    body = f"<h2 class='section-header'>Head</h2><p>{text}</p><p class='alert'>Mind this.</p>"
    want = "Head\n" + text.strip() + "\nMind this."
    for wrap in ("class='layout has-sidebar'", "id='post' class='comments-open'", "class='search-result-page'", "class='widget'"):
        for mark in ("article", "main"):
            page = f"<body><div {wrap}><{mark}>{body}</{mark}></div><div class='sidebar'>side</div></body>"
            assert html_extract.main_text(page) == want
    assert "Their past" in html_extract.main_text(f"<article><p>{text}</p><section id='social-history'>Their past</section></article>")
    plain = f"<body><div class='content'><p>{text}</p><p>{text}</p></div><article><p>A teaser.</p></article></body>"
    assert html_extract.main_text(plain).startswith(text.strip() + "\n" + text.strip())
    most = f"<body><p>{text}</p><div id='comments'><p>{text * 3}</p></div></body>"
    assert html_extract.main_text(most) == text.strip()
    less = f"<body><p>{text}</p><div class='cookie-notice'>We use them.</div><div class='ad box'>buy</div></body>"
    assert html_extract.main_text(less) == text.strip()


def test_html_noise_goes_whatever_its_size():
    article, long = "word " * 20, "noise " * 60
    for noise in ("<div id='comments'><p>{}</p></div>", "<div class='sidebar'><p>{}</p></div>", "<div role='alert'>{}</div>",
                  "<aside>{}</aside>", "<div class='cookie-notice'><div><p>{}</p></div></div>"):
        noise = noise.format(long)
        assert html_extract.main_text(f"<body><p>{article}</p>{noise}</body>") == article.strip()
        assert html_extract.main_text(f"<body><article><p>{article}</p>{noise}</article></body>") == article.strip()
        assert html_extract.main_text(f"<body>{noise}</body>") == ""
    inside = f"<article><p>{article}</p><section class='comments'><p>{long}</p></section></article>"
    assert html_extract.main_text(inside) == article.strip()


def test_html_headings_and_link_paragraphs():
    text = "word " * 40
    short = "<h1>Title</h1><p>First few words.</p><p>Then some more.</p>"
    want = "Title\nFirst few words.\nThen some more."
    assert html_extract.main_text(f"<body>{short}</body>") == want
    assert html_extract.main_text(f"<body><ul><li><a href='/'>Home</a></ul>{short}<p>{text}</p></body>") == want + "\n" + text.strip()
    assert html_extract.main_text("<p><a href=x>only a link</a></p>") == "only a link"
    assert html_extract.main_text("<ul><li><a href=x>only a menu</a></li></ul>") == ""
    assert html_extract.main_text(f"<p>{text}</p><p><a>see this</a></p><p>{text}</p>").split("\n")[1] == "see this"
    head = f"<article><header><h1>Title</h1><p>By someone</p></header><p>{text}</p></article><header><h1>Site</h1></header>"
    assert html_extract.main_text(head) == "Title\n" + text.strip()
    assert html_extract.main_text("<article><p>so <math><mi>x</mi></math> is <object>no plugin</object></p></article>") == "so x is"


def test_html_edges(spark):
    rows = [(1, None, "u"), (2, "<article><p>" + "wide words " * 100_000 + "</p></article>", "v"), (2, "<p>", None), (None, "<p", "w")]
    df = spark.createDataFrame([(*r, "old", 3) for r in rows], "page_id long, html string, url string, text string, n_chars int")
    got = html_extract.extract_text(df)
    assert got.columns == df.columns
    assert [(r["page_id"], len(r["text"])) for r in got.collect()] == [(1, 0), (2, 1_099_999), (2, 0), (None, 0)]
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_hmm_unknown_word_keeps_its_base_probability():
    rnd = np.random.default_rng(3)
    c = rnd.integers(1, 50, 30).astype(float)
    n, v = c.sum(), len(c)
    words = np.append(np.ones(v), 1)
    base = np.append(c, 0.0) + hmm.ADD * words
    frequency = base / base.sum()
    emit = np.vstack([rnd.dirichlet(np.ones(v), 4).T * n / 4, np.zeros(4)])      # nothing counts for the unknown word
    got = hmm.smoothed(emit, frequency, words)
    assert np.allclose(got.sum(axis=0), 1)
    assert np.allclose(got[-1], hmm.ADD / (n + hmm.ADD * (v + 1)))
    # several known words without a symbol: their counts are learnt, the unknown one's share is not lost
    emit[-1] = [5.0, 0.0, 1.0, 2.0]
    assert (hmm.smoothed(emit, frequency, words)[-1] >= hmm.ADD / (n + 8 + hmm.ADD * (v + 1)) * 0.99).all()


def test_hmm_segments_count_everything_once():
    rnd = np.random.default_rng(5)
    texts = [rnd.integers(0, 6, k).astype(np.int32) for k in (1, 2, 5, 6, 11, 37)]
    seqs, inner = hmm.segments([t.tobytes() for t in texts], 5)
    t = hmm.first_tables(np.full(6, 1 / 6), 3)
    start, move, emit, score = hmm.expected_counts(seqs, t, inner)
    assert np.isclose(start.sum(), len(texts)) and np.isclose(move.sum(), sum(len(x) - 1 for x in texts))
    assert np.allclose(emit.sum(axis=1), np.bincount(np.concatenate(texts), minlength=6))
    whole = hmm.expected_counts(texts, t)
    assert np.isclose(score, whole[3], rtol=0.02) and np.allclose(emit.sum(axis=1), whole[2].sum(axis=1))
    p = hmm.stationary(t.move)
    assert np.allclose(p @ t.move, p) and np.isclose(p.sum(), 1)


def test_hmm_scores_held_out_texts_above_the_base(spark):
    for sf in ("sf0.001", "sf0.01"):
        held = hmm.op7_hmm(spark, f"/root/testdata/{sf}").where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
        assert held[0] > held[1]


def test_forest_strings_and_ascent():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(50, 9))
    normals = prefix_forest.planes(9, 3)
    codes = prefix_forest.hash_strings(x, normals)
    bits = (x.astype(np.float32) @ normals > 0).reshape(50, 3, prefix_forest.BITS)
    want = [[int("".join("01"[int(b)] for b in tree), 2) for tree in row] for row in bits]
    assert codes.tolist() == want
    same = prefix_forest.common_bits(codes[:1], codes)
    assert same[0].tolist() == [prefix_forest.BITS] * 3
    assert all(same[i, t] == next(k for k in range(61) if k == 60 or bits[0, t, k] != bits[i, t, k])
               for i in range(1, 50) for t in range(3))

    # binary descent in one sorted array: runs of every prefix length
    cells, counts = np.unique(rnd.integers(0, 1 << prefix_forest.STEP, 300), return_counts=True)
    got = prefix_forest.run_lengths(cells, counts, cells)
    for bits_in in range(1, prefix_forest.STEP + 1):
        cut = prefix_forest.STEP - bits_in
        assert got[:, bits_in - 1].tolist() == [int(counts[cells >> cut == c >> cut].sum()) for c in cells]

    # two trees, depths 1 to 3: all up to the last depth that holds enough, then tree by tree
    lengths = np.array([[9, 5, 2], [8, 4, 1]])
    assert prefix_forest.ascent(lengths, 3).tolist() == [3, 3]
    assert prefix_forest.ascent(lengths, 4).tolist() == [2, 3]
    assert prefix_forest.ascent(lengths, 7).tolist() == [2, 2]
    assert prefix_forest.ascent(lengths, 10).tolist() == [1, 2]
    assert prefix_forest.ascent(lengths, 18).tolist() == [0, -1]
    assert prefix_forest.ascent(np.array([[9, 5], [8, 0]]), 5).tolist() == [2, -1]


def test_forest_of_repeated_ids_and_hot_runs_deeper_than_the_directory(spark):
    rnd = np.random.default_rng(12)
    x = rnd.normal(size=(400, 12))
    x[200:] = x[200] + 1e-5 * rnd.normal(size=(200, 12))
    rows = [(i, [float(a) for a in v], "x") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + rows[:50] + [(None, [1.0] * 12, "x")], "vec_id long, embedding array<double>, strings string")
    got = {}
    for r in prefix_forest.nearest(df, k=5, every=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(got) == list(range(0, 400, 20))
    for q in range(200, 400, 20):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(400), -s))[:5].tolist()
        assert len(set(want) & {v for _, v in got[q]}) >= 4 and [r for r, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
