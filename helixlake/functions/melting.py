"""Lengths of primers by their melting temperatures, a batch at a time.

The sums are those of `seq.santa_lucia`, pair by pair in the same order, for all sequences of a batch at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from . import seq

_ACGT = np.full(128, 4)
_ACGT[[ord(c) for c in "ACGT"]] = range(4)
_H, _S = (np.array([[float(seq.NEAREST_NEIGHBOURS.get(a + b, (0.0, 0.0))[k]) for b in "ACGT."] for a in "ACGT."]) for k in (0, 1))
_COMPLEMENT = np.arange(128, dtype=np.uint32)
_COMPLEMENT[[ord(c) for c in seq.DNA_LETTERS]] = [ord(c) for c in seq.DNA_COMPLEMENTS]


def primer_lengths(sequences: list[str], target: float, shortest: int, longest: int, primer: float = 500e-9, salt: float = 50e-3, magnesium: float = 0.0) -> np.ndarray:
    """Letters of the shortest beginning of each upper-case sequence that melts at `target`; 0 when none does."""
    out = np.zeros(len(sequences), np.int64)
    lengths = np.array([len(s) for s in sequences], np.int64)
    width = min(longest, int(lengths.max(initial=0)))
    x = np.frombuffer("".join(s[:width].ljust(width, "\0") for s in sequences).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, max(width, 1)).T
    plain = np.minimum(x, 127)
    other = np.where(x < 128, _COMPLEMENT[plain], x)
    code = np.where(x < 128, _ACGT[plain], 4)
    h, s = _H[code[:-1], code[1:]], _S[code[:-1], code[1:]]
    rows = np.arange(len(sequences))  # those of which no length has melted
    for n in range(shortest, width + 1):
        long_ = lengths[rows] >= n
        if not long_.all():
            rows, x, other, code, h, s = rows[long_], *(a[:, long_] for a in (x, other, code, h, s))
        own = (x[:n] == other[:n][::-1]).all(axis=0)
        last = (code[n - 1] == 0) | (code[n - 1] == 3)
        dh = seq.INITIATION[0] + np.where(own, seq.SYMMETRY[0], 0.0) + np.where(last, seq.TERMINAL_AT[0], 0.0)
        ds = seq.INITIATION[1] + np.where(own, seq.SYMMETRY[1], 0.0) + np.where(last, seq.TERMINAL_AT[1], 0.0) + 0.368 * (n - 1) * math.log(salt + magnesium * 140)
        for k in range(n - 1):
            dh += h[k]
            ds += s[k]
        tm = dh * 1000 / (ds + seq.GAS_CONSTANT * np.where(own, math.log(primer), math.log(primer / 4.0))) - 273.15
        melted = tm >= target
        if melted.any():
            out[rows[melted]] = n
            rows, x, other, code, h, s = rows[~melted], *(a[:, ~melted] for a in (x, other, code, h, s))
    return out


def primer_length_column(target: float, shortest: int, longest: int):
    """f(upper-case sequence) -> letters of its primer; null when none melts at `target`, and for null."""

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        n = pd.Series(primer_lengths(["" if x is None else x for x in s], target, shortest, longest))
        return n.where(n > 0).astype("Int32")

    return run
