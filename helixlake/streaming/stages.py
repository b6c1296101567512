"""Stages of a sequencing pipeline. Each takes and returns a DataFrame of reads, batch or streaming.

A stream of reads is spark.readStream.format("fastq").load(folder). An error in a stage fails the query; nothing ends
silently. A batch takes all new files, so back-pressure is
the size and number of files that arrive; a query is stopped by query.stop().
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seq
from ..operators import matching

#: Unique k-mers that a stage carries as a dictionary, at most; larger indexes are joined.
CARRIED_KMERS = 5_000_000


def filtered(reads: DataFrame, predicate) -> DataFrame:
    """Rows for which a Column or a Python function over pandas Series (sequence) is true."""
    if isinstance(predicate, Column):
        return reads.where(predicate)
    return reads.where(F.pandas_udf(predicate, "boolean")("sequence"))


def with_megamash(reads: DataFrame, templates: DataFrame, k: int = 16, threshold: float = 0.5) -> DataFrame:
    """reads whose optionals hold `megamash`: JSON of the templates that match, best first, `null` without one.

    On a stream the index (its size is checked) is carried to the workers, since counting by read would need state; in
    batch the same function can be had as a join, matching.match_templates().
    """
    index = matching.unique_kmer_index(templates, k)
    rows = index.limit(CARRIED_KMERS + 1).collect()
    if len(rows) > CARRIED_KMERS:
        raise ValueError(f"more than {CARRIED_KMERS} unique k-mers; use matching.match_templates() in batch or foreachBatch")
    known = reads.sparkSession.sparkContext.broadcast(({r.kmer: r.identifier for r in rows}, {r.identifier: r.total for r in matching.template_sizes(templates, index).collect()}))

    @F.pandas_udf("string")
    def match(kmers: pd.Series) -> pd.Series:
        names, totals = known.value

        def one(words) -> str | None:
            if words is None:
                return None
            hits: dict[str, int] = {}
            for w in words:
                if (t := names.get(w)) is not None:
                    hits[t] = hits.get(t, 0) + 1
            found = sorted(((n / totals[t], t) for t, n in hits.items() if n / totals[t] > threshold), key=lambda x: (-x[0], x[1]))
            return json.dumps([{"identifier": t, "score": s} for s, t in found], separators=(",", ":")) if found else "null"

        return kmers.map(one)

    made = reads.withColumn("__m", match(seq.canonical_kmers("sequence", k)))
    return made.withColumn("optionals", F.map_concat(F.map_filter("optionals", lambda k, _: k != "megamash"), F.create_map(F.lit("megamash"), F.col("__m")))).drop("__m")


def reads_per_barcode(reads: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """window, barcode, n by the start_time that reads carry; late reads are dropped after `late`."""
    timed = reads.select(F.to_timestamp(F.try_element_at("optionals", F.lit("start_time"))).alias("ts"), F.try_element_at("optionals", F.lit("dual_barcode")).alias("barcode"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", window), "barcode").agg(F.count("*").alias("n"))
