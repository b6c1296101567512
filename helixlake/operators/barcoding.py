"""Dual barcodes: which well a read comes from, by local alignment of its ends with barcodes and primers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.align import Scoring, local_scores
from ..functions.cloning import revcomp

LEAST_SCORE = 28
LEAST_READ = 200
EDGE = 120
#: Sets of barcodes are lists; more than this is an error.
MAX_BARCODES = 100_000


class PrimerSet:
    """Wells by (forward, reverse), and the distinct barcodes of both kinds in order."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        self.wells = {(f, r): name for name, f, r in rows}
        self.barcodes = {name: (f, r) for name, f, r in rows}
        self.forward = sorted({f for _, f, _ in rows})
        self.reverse = sorted({r for _, _, r in rows})


def primer_set(barcodes: DataFrame) -> PrimerSet:
    """From a table (name, forward, reverse), whose size is checked."""
    rows = barcodes.select("name", "forward", "reverse").limit(MAX_BARCODES + 1).collect()
    if len(rows) > MAX_BARCODES:
        raise ValueError(f"more than {MAX_BARCODES} barcodes")
    return PrimerSet([(r.name, r.forward, r.reverse) if isinstance(r.name, str) else (r["name"], r["forward"], r["reverse"]) for r in rows])


_SCORING = Scoring("ACGTU")


def _best(ends: tuple[list[str], list[str]], barcodes: list[str], primer: str, least: int) -> list[str]:
    """Of each read: fold over (end, barcode): a barcode is taken when it beats the best so far as it is, else when its
    complement does. The score by which it was taken is the bar for those after it."""
    chosen = np.full(len(ends[0]), -1)
    bar = np.full(len(chosen), max(0, least), np.int64)
    for side in ends if barcodes else ():
        alike: dict[int, list[int]] = {}
        for k, end in enumerate(side):
            alike.setdefault(len(end), []).append(k)
        for rows in map(np.array, alike.values()):
            codes = np.stack([_SCORING.encode(side[k]) for k in rows])
            for number, b in enumerate(barcodes):
                words = [_SCORING.encode(w) for w in (b + primer, revcomp(b + primer))]
                this, other = local_scores(codes, words, _SCORING)
                level = bar[rows]
                score = np.where(this > level, this, other)
                taken = score > level
                chosen[rows[taken]], bar[rows[taken]] = number, score[taken]
    return [barcodes[k] if k >= 0 else "" for k in chosen]


def wells(sequences: list[str], forward_primer: str, reverse_primer: str, primers: PrimerSet, least: int = LEAST_SCORE, shortest: int = LEAST_READ, edge: int = EDGE) -> list[str]:
    """Names of the wells, or empty strings; reads are aligned side by side."""
    out = [""] * len(sequences)
    long_ = [k for k, s in enumerate(sequences) if len(s) >= shortest]
    upper = [sequences[k].upper() for k in long_]
    ends = [s[:edge] for s in upper], [s[-edge:] for s in upper]
    f = _best(ends, primers.forward, forward_primer.upper(), least)
    r = _best(ends, primers.reverse, reverse_primer.upper(), least)
    for k, x, y in zip(long_, f, r, strict=True):
        out[k] = primers.wells.get((x, y), "") if x and y else ""
    return out


def well(sequence: str, forward_primer: str, reverse_primer: str, primers: PrimerSet, least: int = LEAST_SCORE, shortest: int = LEAST_READ, edge: int = EDGE) -> str:
    """Name of the well, or an empty string."""
    return wells([sequence], forward_primer, reverse_primer, primers, least, shortest, edge)[0]


def well_column(forward_primer: str, reverse_primer: str, primers: PrimerSet, least: int = LEAST_SCORE, shortest: int = LEAST_READ, edge: int = EDGE):
    """f(sequence) -> name of the well. The set goes with the function to the workers."""

    @F.pandas_udf("string")
    def run(sequence: pd.Series) -> pd.Series:
        there = sequence.dropna()
        return pd.Series(wells(list(there), forward_primer, reverse_primer, primers, least, shortest, edge), index=there.index, dtype=object).reindex(sequence.index)

    return run


def demultiplexed(reads: DataFrame, barcodes: DataFrame, forward_primer: str, reverse_primer: str, **kw) -> DataFrame:
    """reads with a column `well`; batch or streaming."""
    return reads.withColumn("well", well_column(forward_primer, reverse_primer, primer_set(barcodes), **kw)("sequence"))


def with_barcode(reads: DataFrame, barcodes: DataFrame, forward_primer: str, reverse_primer: str, **kw) -> DataFrame:
    """reads whose optionals hold dual_barcode; batch or streaming."""
    w = well_column(forward_primer, reverse_primer, primer_set(barcodes), **kw)("sequence")
    return reads.withColumn("__w", w).withColumn("optionals", F.map_concat(F.map_filter("optionals", lambda k, _: k != "dual_barcode"), F.create_map(F.lit("dual_barcode"), F.col("__w")))).drop("__w")


__all__ = ["PrimerSet", "demultiplexed", "primer_set", "well", "well_column", "wells", "with_barcode"]
