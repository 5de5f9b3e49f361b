"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (chat_format, circulant_minhash, decontaminate, hmm, html_extract, mixing, nbsvm, nn_descent,
               periodic_runs, piece_bpe, prefix_forest, shared_queries, url_filter)
from .common import ship

_OPERATORS = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_nn_descent": nn_descent.op2_nn_descent,
    "op3_soft_mixing": mixing.op3_soft_mixing,
    "op4_circulant_minhash": circulant_minhash.op4_circulant_minhash,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_prefix_forest": prefix_forest.op6_prefix_forest,
    "op7_hmm": hmm.op7_hmm,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_piece_bpe": piece_bpe.op9_piece_bpe,
    "op10_nbsvm": nbsvm.op10_nbsvm,
    "op11_shared_queries": shared_queries.op11_shared_queries,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_aho_corasick": decontaminate.op13_aho_corasick,
}

def _registered(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    return run


QUERIES = {name: _registered(fn) for name, fn in _OPERATORS.items()}

ORACLE_SQL = {
    "op5_chat_format": chat_format.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op11_shared_queries": shared_queries.ORACLE,
    "op13_aho_corasick": decontaminate.ORACLE,
}
