"""The corpus queries: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries as q
from .oracles import ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        q.op1_rule_classifier, q.op2_token_counts, q.op3_line_dedup, q.op4_ngram_join, q.op5_mixing,
        q.op6_sharding, q.op7_decontamination, q.op8_warc, q.op9_language_id, q.op10_quality_rules,
        q.op11_lexical_search, q.op12_conversation_trie, q.op13_substring_dedup,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in queries()}
