"""Corpus pipeline over ``documents``: quality, near duplicates, mixing, tokens.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet to the shared checkpoint folder and read again as the next one's docs.
All but the last return the columns of ``documents``.

Defined results: a null or empty text is judged as any other; documents without
words are near duplicates of none; rows that repeat an id are one document
from the near-duplicate stage on, rows without an id all pass it; an empty
table stays empty through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stintwise.llm import circulant_minhash, mixing, nbsvm, piece_bpe
from stintwise.llm.common import ship, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    ship(spark)
    model = nbsvm.fit_quality(docs, table(spark, sf_dir, "labels"))
    return nbsvm.score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship(spark)
    return circulant_minhash.keep_one_each(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates towards the target weights say."""
    ship(spark)
    return mixing.mix_documents(docs, table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed documents."""
    ship(spark)
    return piece_bpe.digest_documents(docs, piece_bpe.model_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

#: The classifier, hashing and tokeniser stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
