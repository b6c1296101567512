"""The queries of this package, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, mixing, ngram_join, ranking, rules, sharding, substrings, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substrings.op1,
    "op2_chat_format": chat.op2,
    "op3_ngram_join": ngram_join.op3,
    "op4_shard": sharding.op4,
    "op5_token_ids": tokens.op5,
    "op6_quality_rules": rules.op6,
    "op7_toxicity": toxicity.op7,
    "op8_quality_rank": ranking.op8,
    "op9_decontaminate": decontaminate.op9,
    "op10_mix": mixing.op10,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": substrings.SQL,
    "op2_chat_format": chat.SQL,
    "op3_ngram_join": ngram_join.SQL,
    "op9_decontaminate": decontaminate.SQL,
}
