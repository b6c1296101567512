"""Queries over folding. Energies are made up by a rule: no table of measured ones is in the repository."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contrafold, zuker
from ..functions.folding import LETTERS, PAIRS
from ..session import spread, table
from .catalogue import query


def made_up_tables(letters: str) -> str:
    """Tables for `zuker.Tables`: stacks by their number of G and C, loops dearer by size, dangling letters free."""
    a, c, g, t = letters
    partner = dict(zip(letters, (t, g, c, a), strict=True))
    stacks = {f"{x}{y}/{partner[x]}{partner[y]}": [-1.0 - sum(v in (c, g) for v in (x, y)), 0.0] for x in letters for y in letters}
    ends = {k: [0.0, 0.0] for x in letters for y in letters for k in (f"{y}{x}/.{partner[x]}", f".{x}/{y}{partner[x]}")}
    sizes = {name: {k: [round(base + k / 10, 1), 0.0] for k in range(1, 31)} for name, base in (("hairpin", 4.0), ("bulge", 3.0), ("internal", 1.0))}
    return json.dumps({"nearest_neighbors": stacks, "dangling_ends": ends, "multibranch": [2.0, 0.2, 0.2, 1.0]} | sizes)


@query()
def fold_zuker(spark: SparkSession, sf: str) -> DataFrame:
    """Structures of 32 letters from a hash of each supplier's key; odd keys give RNA."""
    dna = F.translate(F.md5(F.col("s_suppkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    sequence = F.when(F.col("s_suppkey") % 2 == 1, F.translate(dna, "T", "U")).otherwise(dna)
    fold = zuker.fold_column(made_up_tables("ACGT"), made_up_tables("ACGU"))
    folded = spread(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey").select("s_suppkey", sequence.alias("sequence")).withColumn("fold", fold("sequence"))
    return folded.select("s_suppkey", "sequence", "fold.structure", F.round("fold.energy", 6).alias("energy"), F.size("fold.loops").alias("n_loops"))


def made_up_weights() -> str:
    """A parameter file for `contrafold.Weights`: pairs and stacks pay by their number of G and C, loops cost by size."""
    rows = {name: -0.01 for name in contrafold.SINGLES} | {"multi_base": -1.0, "multi_paired": -0.5}
    rows |= {f"{name}_at_least_{n}": (-2.0 if n == low else -0.1) for name, (low, high) in contrafold.LENGTHS.items() for n in range(low, high + 1)}
    rows |= {f"internal_explicit_{a}_{b}": (b - a) / 10 for a in range(1, contrafold.EXPLICIT + 1) for b in range(a, contrafold.EXPLICIT + 1)}
    strong = lambda x: sum(c in "CG" for c in x) / 4
    for p in PAIRS:
        rows |= {f"base_pair_{p}": strong(p), f"helix_closing_{p}": strong(p) - 0.7}
        rows |= {f"helix_stacking_{p}{q}": 0.2 + strong(p + q) / 2 for q in PAIRS}
        rows |= {f"{name}_{p}{x}": (k - strong(x)) / 10 for x in LETTERS for k, name in enumerate(("dangle_left", "dangle_right"))}
        rows |= {f"terminal_mismatch_{p}{x}{y}": (strong(x) - strong(y)) / 5 for x in LETTERS for y in LETTERS}
    rows |= {f"bulge_0x1_nucleotides_{x}": -strong(x) for x in LETTERS} | {f"internal_1x1_nucleotides_{x}{y}": strong(x + y) for x in LETTERS for y in LETTERS}
    return "\n".join(f"{name} {value}" for name, value in rows.items())


@query()
def fold_contrafold(spark: SparkSession, sf: str) -> DataFrame:
    """Structures of 32 letters from a hash of each supplier's key, by learned weights' features and a beam of 100."""
    rna = F.translate(F.md5(F.col("s_suppkey").cast("string").cast("binary")), "0123456789abcdef", "ACGUACGUACGUACGU")
    folded = spread(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey").select("s_suppkey", rna.alias("sequence")).withColumn("fold", contrafold.fold_column(made_up_weights())("sequence"))
    return folded.select("s_suppkey", "sequence", "fold.structure", F.round("fold.score", 6).alias("score"))
