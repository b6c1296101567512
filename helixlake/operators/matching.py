"""Reads against templates: unique k-mer index, template scores, k-mer containment, sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import seq


def unique_kmer_index(templates: DataFrame, k: int = 16, least: int | None = None) -> DataFrame:
    """kmer, identifier: canonical k-mers that stand in exactly one record of templates (identifier, sequence).

    Records are told apart by their own row, not by name, so equal names add up. With `least`, a name with fewer unique
    k-mers raises an error at once.
    """
    rows = templates.select("identifier", F.monotonically_increasing_id().alias("rec"), F.explode(F.array_distinct(seq.canonical_kmers("sequence", k))).alias("kmer"))
    index = rows.groupBy("kmer").agg(F.count("*").alias("n"), F.min("identifier").alias("identifier")).where("n = 1").select("kmer", "identifier")
    if least is None:
        return index
    short = template_sizes(templates, index).where(F.col("total") < least).orderBy("identifier").first()
    if short:
        raise ValueError(f"Got only {short.total} unique kmers of required {least} for sequence {short.identifier}")
    return index


def template_sizes(templates: DataFrame, index: DataFrame) -> DataFrame:
    """identifier, total: unique k-mers of every name, 0 included."""
    n = index.groupBy("identifier").agg(F.count("*").alias("total"))
    return templates.select("identifier").distinct().join(n, "identifier", "left").select("identifier", F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def match_templates(reads: DataFrame, templates: DataFrame, k: int = 16, threshold: float = 0.5, read_id: str = "read_id") -> DataFrame:
    """read_id, identifier, score: share of a template's unique k-mers that a read holds (every place counts), above the
    threshold.

    K-mers of reads and index meet in an equi-join that Spark broadcasts or shuffles by size. Places are counted
    in each read before it, so that a k-mer which many places share is sent once for each read, and only those of the index
    are sent on where the index is small.
    """
    index = unique_kmer_index(templates, k)
    sizes = template_sizes(templates, index)
    places = reads.select(read_id, F.explode(seq.kmer_counts("sequence", k)).alias("w")).select(read_id, "w.kmer", "w.n")
    hits = places.join(index, "kmer").groupBy(read_id, "identifier").agg(F.sum("n").alias("hits"))
    return hits.join(sizes, "identifier").select(read_id, "identifier", (F.col("hits") / F.col("total")).alias("score")).where(F.col("score") > threshold)


def matches_json(matches: DataFrame, read_id: str = "read_id") -> DataFrame:
    """read_id, megamash: matches of a read as JSON, best first."""
    order = F.expr("array_sort(m, (a, b) -> case when a.score > b.score then -1 when a.score < b.score then 1 when a.identifier < b.identifier then -1 else 1 end)")
    return matches.groupBy(read_id).agg(F.collect_list(F.struct("identifier", "score")).alias("m")).select(read_id, F.to_json(order).alias("megamash"))


def json_matches(column: str):
    """Native: JSON to an array of (identifier, score)."""
    return F.from_json(column, "array<struct<identifier:string,score:double>>")


def find_kmers_theta(reads: DataFrame, overlaps: DataFrame, read_id: str = "read_id") -> DataFrame:
    """read_id, kmer for k-mers that a read holds on either strand, by containment; for k-mers of mixed lengths.

    A nested loop by nature. `overlaps` is a list of junctions; equal lengths are better served by find_kmers().
    """
    k = overlaps.select("kmer").distinct()
    up = F.upper("sequence")
    return reads.select(read_id, up.alias("s")).join(k, F.col("s").contains(F.upper("kmer")) | F.col("s").contains(seq.reverse_complement(F.upper("kmer")))).select(read_id, "kmer")


def find_kmers(reads: DataFrame, overlaps: DataFrame, k: int, read_id: str = "read_id") -> DataFrame:
    """The same for k-mers of one length k, as an equi-join on canonical k-mers."""
    wanted = overlaps.select("kmer").distinct().select("kmer", seq.canonical("kmer").alias("c"))
    held = reads.select(read_id, F.explode(F.array_distinct(seq.canonical_kmers("sequence", k))).alias("c"))
    return held.join(wanted, "c").select(read_id, "kmer")


def sketch_similarity(a: DataFrame, b: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """a_id, b_id, similarity of all pairs that share a value; a and b hold (id, sketch).

    Equal values are counted as often as both sketches hold them, over the smaller sketch size.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("id").alias(name), F.explode("sketch").alias("v")).groupBy(name, "v").agg(F.count("*").alias(f"n_{name}"))

    both = counted(a, "a_id").join(counted(b, "b_id"), "v").groupBy("a_id", "b_id").agg(F.sum(F.least("n_a_id", "n_b_id")).alias("same"))
    return both.select("a_id", "b_id", (F.col("same") / F.lit(float(min(size_a, size_b)))).alias("similarity"))


def junction_kmers(fragments: DataFrame, k: int) -> DataFrame:
    """reaction, ordinal, kmer across each junction of a circular ligation.

    fragments: reaction, ordinal (the order of ligation), sequence, forward_overhang. k is 12 at least. The product is
    the fragments in order, each with its forward overhang; a junction lies where the next one begins, round the end.
    """
    side = (k - 4) // 2
    if side < 4:
        raise ValueError("need at least a kmer of 12")
    part = fragments.select("reaction", "ordinal", F.concat("forward_overhang", "sequence").alias("s"))
    order = W.partitionBy("reaction").orderBy("ordinal")
    whole = part.groupBy("reaction").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "s"))), lambda x: x.s), "").alias("p"), F.count("*").alias("n"))
    placed = part.withColumn("at", F.sum(F.length("s")).over(order.rowsBetween(W.unboundedPreceding, 0))).join(whole, "reaction")
    checked = F.when(F.col("n") < 2, F.raise_error(F.lit("need at least two fragments to find overlaps")).cast("string")).otherwise(F.concat("p", "p"))
    return placed.select("reaction", "ordinal", seq.canonical(F.substring(checked, F.col("at").cast("int") - side + 1, F.lit(4 + 2 * side))).alias("kmer"))
