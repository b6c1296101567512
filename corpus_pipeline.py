"""A corpus from documents to token shards, in stages that are written and read again.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of documents; the last one
returns what it reads back from its files. Nothing here is SQL's to say (the first stage is learned, the mix is drawn by
a pseudorandom permutation, the last is a tokenizer), so ORACLE_SQL is None and the tests hold stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixlake.llm import decontaminate, mixing, ngram_join, tokens, toxicity
from helixlake.llm.common import table, written

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It is learned from all documents of sf_dir that have labels."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; a single passage is a leak here."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), least_items=1)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, a row for each epoch."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of all rows; per row doc_id, start, n_tokens, ids_crc32, read back from the shards."""
    return tokens.digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
