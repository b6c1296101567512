"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass 1 scatters whole records uniformly into buckets of a bounded size by a seeded hash of doc_id and text. Pass 2 brings
each bucket into memory, shuffles it there (the built-in shuffle() is Fisher-Yates with a seed) and numbers it on from
the buckets before it. Record r of the whole order goes to shard r mod n, slot r div n, so that the law ``rows`` holds:
counts of shards are at most one apart, and slots have no gaps.

Defined results: a null text counts as empty (size 1, crc32 0); a null doc_id is scattered by its text; equal texts with
different ids are scattered like any others; rows equal in all of doc_id and text go to one bucket and take different
slots in any order; an empty table gives no rows. Columns of any name pass through, except that `shard` and `slot` of
the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: Bytes of text in a bucket, on average. A task holds one bucket at a time and its shuffled copy.
BUCKET_BYTES = 16 << 20


def shuffled(docs: DataFrame, shards: int = 8, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of docs, then shard and slot."""
    spark = docs.sparkSession
    cols = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    text = F.coalesce(F.col("text"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text) + 1).alias("bytes")).first().bytes or 0
    n = max(-(-total // bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), text)
    rows = docs.select(F.pmod(key, F.lit(n)).cast("long").alias("__bucket"), F.struct(F.xxhash64(F.lit(seed + 1), F.coalesce("doc_id", F.lit(-1)), text).alias("order"), F.struct(*cols).alias("row")).alias("__row"))
    # counts of the buckets, a row each; their running sum tells where each bucket begins
    counts = docs.groupBy(F.pmod(key, F.lit(n)).cast("long").alias("__bucket")).agg(F.count("*").alias("n"))
    begins = counts.select("__bucket", (F.sum("n").over(W.orderBy("__bucket")) - F.col("n")).alias("__begin"))
    grouped = rows.groupBy("__bucket").agg(F.collect_list("__row").alias("rows")).join(begins.hint("shuffle_hash"), "__bucket").sortWithinPartitions("__bucket")
    by_order = lambda a, b: F.when(a.order < b.order, -1).when(a.order > b.order, 1).otherwise(0)
    mixed = grouped.select("__begin", F.shuffle(F.array_sort("rows", by_order), seed).alias("rows"))
    placed = mixed.select("__begin", F.posexplode("rows").alias("pos", "r")).select((F.col("__begin") + F.col("pos")).alias("__at"), "r.row")
    return placed.select("row.*", F.pmod("__at", F.lit(shards)).cast("int").alias("shard"), F.expr(f"__at div {shards}").alias("slot"))


def write(shuffled_docs: DataFrame, path: str) -> None:
    """One folder for each shard; a bucket's rows stand in each file in the order of slots."""
    shuffled_docs.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shuffled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
