"""Mutation calls over pileup lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _results(read_results: str | Column) -> Column:
    """What each read says: marks of read ends are cut off; a result with both marks counts as its first letter."""
    r = F.col(read_results) if isinstance(read_results, str) else read_results
    return F.transform(r, lambda x: F.when(F.length(x) == 1, x).when(x.contains("$"), F.substring(x, 1, 1)).when(x.contains("^"), F.substring(x, -1, 1)).otherwise(x))


def call_mutation(read_results: str | Column, reference_base: str | Column, least_ratio: float) -> Column:
    """Struct type, from, to, length, total_correct, total_mutated, total_aligned.

    In order: A, T, G, C, deletion mark, insertion or deletion (the most frequent, of equal ones the smallest), noise.
    A deletion has a negative length. No reads: no mutation.
    """
    ref = F.col(reference_base) if isinstance(reference_base, str) else reference_base
    reads = _results(read_results)
    n = F.size(reads)
    count = lambda *keys: F.size(F.filter(reads, lambda x: x.isin(*keys)))
    often = lambda k: (n > 0) & (k / n >= least_ratio)
    correct = count(".", ",")
    call = lambda kind, start, to, length, mutated: F.struct(F.lit(kind).alias("type"), start.alias("from"), to.alias("to"), length.cast("int").alias("length"), correct.alias("total_correct"), mutated.alias("total_mutated"), n.alias("total_aligned"))
    none, zero = F.lit(""), F.lit(0)
    long_ = F.filter(reads, lambda x: F.length(x) > 1)
    kinds = F.transform(F.array_distinct(long_), lambda k: F.struct((-F.size(F.filter(long_, lambda x: x == k))).alias("less"), k.alias("key")))
    top = F.array_min(kinds)
    mutated = -top.less
    noise = n - correct
    out = None
    for base in "ATGC":
        k = count(base, base.lower())
        hit = often(k)
        out = F.when(hit, call("point", ref, F.lit(base), zero, k)) if out is None else out.when(hit, call("point", ref, F.lit(base), zero, k))
    gap = count("*")
    size = F.regexp_extract(top.key, r"(-?\d+)", 1).cast("int")
    return (
        out.when(often(gap), call("point_indel", ref, F.lit("*"), zero, gap))
        .when((F.size(kinds) > 0) & often(mutated) & top.key.startswith("-"), call("indel", none, top.key, size, mutated))
        .when((F.size(kinds) > 0) & often(mutated), call("insertion", none, top.key, size, mutated))
        .when(often(noise), call("noisy", none, F.lit("?"), zero, noise))
        .otherwise(call("no_mutation", none, F.lit("."), zero, noise))
    )
