"""Empty tables, nulls and repeated rows, operator by operator and through the pipeline."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stintwise.llm import chat_format, hmm, nn_descent
from stintwise.llm.common import ship

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def test_chat_format_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    empty = empty.withColumn("parts", chat_format.text_part(F.col("text")))
    got = chat_format.format_chat(empty)
    assert got.count() == 0 and chat_format.chat_digests(got).count() == 0


def test_near_vectors_of_repeated_ids(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(30, 16))
    x[5] = x[4]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(4, [float(a) for a in x[4]])] * 3
    df = spark.createDataFrame(rows + [(None, [1.0] * 16)], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in nn_descent.near_vectors(df).collect()}
    # rows that repeat an id are one vector
    assert (4, 1, 4) in got and (5, 1, 4) in got
    assert all(n == 0 for i, n, _ in got if i not in (4, 5))


def test_hmm_of_null_ids_and_texts(spark):
    df = spark.createDataFrame([(None, "a b a"), (1, None), (2, ""), (2, "")], "doc_id long, text string")
    got = hmm.score_documents(df, states=2).collect()
    assert len(got) == 4
    assert all(not r["held_out"] for r in got if r["doc_id"] is None)
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 1, 4]
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)


@pytest.mark.parametrize("rows", ["none", "nulls"])
def test_pipeline_stages_on_edges(spark, rows):
    given = {
        "none": [],
        "nulls": [(None, None, None, None, None), (None, "some words", None, None, 10), (7, "", "en", "web", 0),
                  (7, "", "en", "web", 0), (8, "one two three four five six", "en", "web", 27)],
    }[rows]
    docs = spark.createDataFrame(given, DOCS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        if name != "tokens":
            assert out.columns == docs.columns
            assert {r["doc_id"] for r in got} <= {r[0] for r in given}
        else:
            assert len(got) == len(given)
        if name == "near_duplicates":
            named = [r["doc_id"] for r in got if r["doc_id"] is not None]
            assert len(named) == len(set(named)) and len(got) - len(named) == sum(r[0] is None for r in given)
        if not given:
            assert got == []
