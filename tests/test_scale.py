"""Work that must grow no faster than the input, and be dealt out over all cores."""

import pytest

from helixlake.plans import catalogue, folds, formats  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["design_primers", "cds_fix", "fragment_sequences", "recursive_fragment", "fold_zuker", "fold_contrafold"])
def test_small_files_are_dealt_out(spark, name):
    assert catalogue.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_primers_are_the_shortest_that_melt(spark):
    from pyspark.sql import functions as F

    from helixlake.functions import seq

    text = F.translate(F.md5(F.col("id").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    rows = spark.range(40).select(text.alias("s")).select("s", seq.design_primers("s", 50.0).alias("p"))
    tried = rows.select("p", F.explode(F.sequence(F.lit(15), F.lit(32))).alias("n"), F.substring("s", F.lit(1), F.col("n")).alias("w")).withColumn("tm", seq.melting_temperature("w"))
    for r in tried.where("tm >= 50").groupBy("p").agg(F.min_by("w", "n").alias("first")).collect():
        assert r.p.forward == r.first


def _reads(n: int, letters: int) -> list[str]:
    import random

    r = random.Random(7)
    return ["".join(r.choices("ACGT", k=letters)) for _ in range(n)]


def test_wells_of_many_reads():
    """Scores are those of one pair at a time; 1500 reads would take over a minute that way."""
    import time

    from helixlake.functions import align
    from helixlake.functions.cloning import revcomp
    from helixlake.operators import barcoding

    a, b, x, y = _reads(4, 24)
    scoring = align.Scoring("ACGTU", None, -2)
    codes = [scoring.encode(s) for s in (a + b, x + y)]
    words = [a[3:20] + x, y[:-4], b + "A"]
    import numpy as np

    for word, found in zip(words, align.local_scores(np.stack(codes), [scoring.encode(w) for w in words], scoring), strict=True):
        assert found.tolist() == [align.local_score(s, word, scoring) for s in (a + b, x + y)]
    primers = barcoding.PrimerSet([("one", a, x), ("two", b, y)])
    reads = [f + "GTTTTCCCAGTCACGAC" + s + revcomp(r + "AGCGGATAACAATTTCACACAGG") for s, f, r in zip(_reads(1500, 300), [a, b, a] * 500, [x, y, y] * 500, strict=True)]
    began = time.time()
    assert barcoding.wells(reads, "GTTTTCCCAGTCACGAC", "AGCGGATAACAATTTCACACAGG", primers) == ["one", "two", ""] * 500
    assert time.time() - began < 20


def test_cuts_of_long_sequences():
    """Each cut is the best of all choices by `set_efficiency`; a sequence of 6000 letters took over a minute by whole sets."""
    import time

    from helixlake.functions import design

    words = [a + b + c + d for a in "ACGT" for b in "ACGT" for c in "ACGT" for d in "ACGT"]
    fidelity = {(x, y): 1000 if x == y else (7 * i + 3 * j) % 5 for i, x in enumerate(words) for j, y in enumerate(words)}
    for s in (_reads(1, 400)[0], _reads(1, 400)[0].replace("ACG", "ANG")):
        pieces, efficiency = design.fragment(s, 60, 90, fidelity, include=words[::3])
        used = [s[:4], s[-4:], *(x[-4:] for x in pieces[:-1])]
        assert efficiency == design.set_efficiency(used, fidelity)
    began = time.time()
    pieces, _ = design.fragment(_reads(1, 6000)[0], 60, 120, fidelity)
    assert len(pieces) > 50 and time.time() - began < 5


def test_repair_of_many_sequences():
    """Checks and choices of codons are made once, not for each sequence."""
    from helixlake.functions import design

    codons = {"K": [("AAA", 1), ("AAG", 3)], "G": [("GGT", 2), ("GGA", 2), ("GGC", 1)]}
    known, checks = design.Synonyms(codons), design.simple_checks(["AAGGGT"])
    for s in ("AAAGGTGGAAAAGGT" * 4, "AAGGGTAAA", "AAGGG"):
        both = []
        for c in (codons, known):
            try:
                both.append(design.repair(s, c, checks))
            except ValueError as e:
                both.append(str(e))
        assert both[0] == both[1]
    assert design.repair("AAGGGTAAA", known, checks)[0] == "AAGGGAAAA"


def test_sites_of_a_long_text(spark):
    """One walk over the letters; places were cut out one by one, each counted from the start."""
    import time

    import pandas as pd

    from helixlake.functions import cloning

    run = cloning.site_places_column({"GGTCTC": (6, True), "AA": (-2, False)}).func
    assert [tuple(x.values()) for x in run(pd.Series(["AAAGGTCTC"]))[0]] == [(10, True), (-1, False), (0, False)]
    began = time.time()
    assert len(run(pd.Series(["ACGTGGTCTC" * 400_000]))[0]) == 400_000
    assert time.time() - began < 10


def test_sites_of_a_long_row(spark):
    import time

    from pyspark.sql import functions as F

    from helixlake.functions import cloning

    began = time.time()
    row = spark.range(1).select(F.repeat(F.lit("ACGTGGTCTC"), 200_000).alias("dna"))
    assert row.select(F.explode(cloning.site_places_column({"GGTCTC": (6, True)})("dna"))).count() == 200_000
    assert time.time() - began < 30


def test_kmers_are_counted_in_their_rows(spark):
    """Only k-mers of the index are dealt out by read; before, all of them were."""
    from pyspark.sql import functions as F

    from helixlake.functions import seq
    from helixlake.operators import matching

    reads = spark.createDataFrame([(k, s) for k, s in enumerate([*_reads(20, 60), "ACGTNNRYACGTTTT", "acg", None])], "read_id int, sequence string")
    one = reads.select("read_id", F.explode(seq.canonical_kmers("sequence", 5)).alias("kmer")).groupBy("read_id", "kmer").count().collect()
    other = reads.select("read_id", F.explode(seq.kmer_counts("sequence", 5)).alias("w")).select("read_id", "w.*").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))
    templates = reads.where("read_id < 3").select(F.col("read_id").cast("string").alias("identifier"), "sequence")
    plan = matching.match_templates(reads, templates, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [read_id" in plan and ", kmer" not in plan.split("Aggregate [read_id")[1].split("]")[0]


def test_sketches_of_prefixes(spark):
    from pyspark.sql import functions as F

    from helixlake.functions import seq

    rows = spark.createDataFrame([(s,) for s in [*_reads(3, 80), "ACGTACGTAC", "", "ACGTéACGTACGTACGT", None]], "s string")
    for r in rows.select("s", seq.sketch("s", 7, 5).alias("v"), F.length("s").alias("n")).collect():
        words = [] if r.s is None else [int.from_bytes(r.s[i : i + 4].encode(), "big") for i in range(max(len(r.s) - 7, 0))]
        assert r.v == (None if r.s is None else sorted(words)[:5] if len(words) >= 5 else words + [0] * (5 - len(words)))
    assert "udf" in str(seq.sketch("s", 7, 5)).lower() or "run(" in str(seq.sketch("s", 7, 5))


def test_locations_that_come_again_are_parsed_once(spark):
    from helixlake.sources import genbank as gb

    assert gb._known_location("join(2..5,9..12)", False) is gb._known_location("join(2..5,9..12)", False)
    assert gb._known_location("7", True) == gb.parse_location("7", True) != gb._known_location("7", False)
    assert [gb.wrap(x, 10) for x in ("", "a b", " a", "a ", "a  b")] == [[""], ["a b"], [" a"], ["a"], ["a  b"]]
