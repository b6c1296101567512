"""Pairwise alignment and sketch distance: plain Python kernels over numpy, and Arrow-batched functions for columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .udf import lazy_pandas_udf

DEFAULT_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Scoring:
    """Substitution scores over an alphabet, and a linear gap penalty (added once for each gap letter)."""

    def __init__(self, letters: str = DEFAULT_LETTERS, scores: list[list[int]] | None = None, gap: int = -1):
        n = len(letters)
        table = np.where(np.eye(n, dtype=bool), 1, -1) if scores is None else np.array(scores, dtype=np.int64)
        if table.shape != (n, n):
            raise ValueError("Alphabet lengths do not match the scores' dimensions")
        self.letters, self.table, self.gap = letters, table, gap
        self.code = np.full(256, -1, np.int64)
        for i, c in enumerate(letters):
            self.code[ord(c)] = i

    def encode(self, s: str) -> np.ndarray:
        raw = np.frombuffer(s.encode("latin-1", "replace"), np.uint8)
        codes = self.code[raw]
        if (codes < 0).any():
            raise ValueError(f"Symbol {s[int(np.argmax(codes < 0))]} not in alphabet")
        return codes

    def score(self, a: str, b: str) -> int:
        return int(self.table[self.encode(a)[0], self.encode(b)[0]])


def read_matrix(text: str, gap: int = -1) -> Scoring:
    """A matrix in the usual text format: comment lines with #, a line of letters, a line of scores for each letter."""
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    letters = "".join(lines[0].split())
    rows = {x.split()[0]: [int(v) for v in x.split()[1:]] for x in lines[1:]}
    return Scoring(letters, [rows[c] for c in letters], gap)


def _fill_all(x: np.ndarray, y: np.ndarray, scoring: Scoring, local: bool) -> np.ndarray:
    """Scores of all prefixes of pairs of equal lengths (codes, a pair a row), by rows of the grids. The dependence along a
    row is a running maximum of score minus the gaps so far."""
    k, m, gap = len(x), y.shape[1], scoring.gap
    slope = gap * np.arange(m + 1)
    out = np.empty((k, x.shape[1] + 1, m + 1), np.int64)
    out[:, 0] = 0 if local else slope
    best = np.empty((k, m + 1), np.int64)
    for i in range(1, x.shape[1] + 1):
        best[:, 0] = 0 if local else gap * i
        np.maximum(out[:, i - 1, :-1] + scoring.table[x[:, i - 1, None], y], out[:, i - 1, 1:] + gap, out=best[:, 1:])
        if local:
            np.maximum(best, 0, out=best)
        out[:, i] = np.maximum.accumulate(best - slope, axis=1) + slope
    return out


def _fill(a: str, b: str, scoring: Scoring, local: bool) -> np.ndarray:
    return _fill_all(scoring.encode(a)[None], scoring.encode(b)[None], scoring, local)[0]


def _trace(a: str, b: str, scoring: Scoring, grid: np.ndarray, i: int, j: int, local: bool) -> tuple[str, str, int, int]:
    """Back from (i, j): diagonal before up before left. Stops at an edge, or at a score of 0 when local."""
    top, low = [], []
    x, y = (scoring.encode(s) for s in (a, b))
    while i > 0 and j > 0 and not (local and grid[i, j] == 0):
        if grid[i, j] == grid[i - 1, j - 1] + scoring.table[x[i - 1], y[j - 1]]:
            i, j = i - 1, j - 1
            top.append(a[i])
            low.append(b[j])
        elif grid[i, j] == grid[i - 1, j] + scoring.gap:
            i -= 1
            top.append(a[i])
            low.append("-")
        else:
            j -= 1
            top.append("-")
            low.append(b[j])
    return "".join(reversed(top)), "".join(reversed(low)), i, j


def needleman_wunsch(a: str, b: str, scoring: Scoring | None = None, full: bool = False) -> tuple[int, str, str]:
    """Global score and alignment. Without `full` the strings begin where one sequence is used up."""
    scoring = scoring or Scoring()
    grid = _fill(a, b, scoring, local=False)
    return _global(a, b, scoring, grid, full)


def _global(a: str, b: str, scoring: Scoring, grid: np.ndarray, full: bool = False) -> tuple[int, str, str]:
    top, low, i, j = _trace(a, b, scoring, grid, len(a), len(b), local=False)
    if full:
        top, low = a[:i] + "-" * j + top, "-" * i + b[:j] + low
    return int(grid[-1, -1]), top, low


def smith_waterman(a: str, b: str, scoring: Scoring | None = None) -> tuple[int, str, str]:
    """Local score and alignment; of equal maxima the first by rows."""
    scoring = scoring or Scoring()
    return _local(a, b, scoring, _fill(a, b, scoring, local=True))


def _local(a: str, b: str, scoring: Scoring, grid: np.ndarray) -> tuple[int, str, str]:
    i, j = np.unravel_index(int(np.argmax(grid)), grid.shape)
    top, low, _, _ = _trace(a, b, scoring, grid, int(i), int(j), local=True)
    return int(grid[i, j]), top, low


def local_score(a: str, b: str, scoring: Scoring | None = None) -> int:
    return int(_fill(a, b, scoring or Scoring(), local=True).max())


def local_scores(x: np.ndarray, words: list[np.ndarray], scoring: Scoring) -> list[np.ndarray]:
    """Local scores of the rows of x (codes, all of one length) against each word; only a row of each grid is kept. Rows of x
    lie side by side, and the dependence along a row is passed on over 1, 2, 4, ... letters."""
    most = int(np.abs(scoring.table).max(initial=1)) + abs(scoring.gap)
    size = most * (x.shape[1] + max(map(len, words)) + 2)
    kind = np.int16 if size < 1 << 15 else np.int32 if size < 1 << 31 else np.int64
    out = [np.zeros(len(x), kind) for _ in words]
    for at in range(0, len(x), _ROWS):
        part = x[at : at + _ROWS]
        scores = np.ascontiguousarray(scoring.table.T.astype(kind)[:, part.T].transpose(1, 0, 2))  # place, letter of the word, row of x
        for y, to in zip(words, out, strict=True):
            row = np.zeros((len(y) + 1, len(part)), kind)
            top, step, gaps = np.zeros_like(row), np.empty_like(row[1:]), np.empty_like(row)
            for score in scores:
                np.take(score, y, axis=0, out=step)
                step += row[:-1]
                row += scoring.gap
                np.maximum(row[1:], step, out=row[1:])
                np.maximum(row, 0, out=row)
                far = 1
                while far <= len(y):
                    np.add(row[:-far], scoring.gap * far, out=gaps[far:])
                    np.maximum(row[far:], gaps[far:], out=row[far:])
                    far *= 2
                np.maximum(top, row, out=top)
            to[at : at + _ROWS] = top.max(axis=0)
    return out


_RESULT = "score int, a string, b string, error string"
#: Grid cells that are filled at once.
_CELLS = 1 << 22
#: Sequences whose scores are filled side by side.
_ROWS = 1024


def _column(trace, scoring: Scoring | None, local: bool, **kw):
    scoring = scoring or Scoring()

    @F.pandas_udf(_RESULT)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = [(None, None, None, None)] * len(a)
        alike: dict[tuple[int, int], list[tuple]] = {}
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            if x is None or y is None:
                continue
            try:
                alike.setdefault((len(x), len(y)), []).append((k, x, y, scoring.encode(x), scoring.encode(y)))
            except ValueError as e:
                rows[k] = (None, None, None, str(e))
        for (n, m), pairs in alike.items():
            step = max(1, _CELLS // ((n + 1) * (m + 1)))
            for at in range(0, len(pairs), step):
                part = pairs[at : at + step]
                grids = _fill_all(np.stack([p[3] for p in part]), np.stack([p[4] for p in part]), scoring, local)
                for (k, x, y, _, _), grid in zip(part, grids, strict=True):
                    rows[k] = (*trace(x, y, scoring, grid, **kw), None)
        return pd.DataFrame(rows, columns=["score", "a", "b", "error"]).astype({"score": "Int32"})

    return run


def needleman_wunsch_column(scoring: Scoring | None = None, full: bool = False):
    """f(a, b) -> struct of score, a, b, error."""
    return _column(_global, scoring, False, full=full)


def smith_waterman_column(scoring: Scoring | None = None):
    """f(a, b) -> struct of score, a, b, error."""
    return _column(_local, scoring, True)


def sketch_similarity(a: list[int], b: list[int]) -> float:
    """Equal values of two sorted sketches, each used once, over the smaller size."""
    if not a or not b:
        return 0.0
    values, counts = np.unique(np.asarray(a), return_counts=True)
    known = dict(zip(values.tolist(), counts.tolist(), strict=True))
    other, n = np.unique(np.asarray(b), return_counts=True)
    return sum(min(known.get(v, 0), k) for v, k in zip(other.tolist(), n.tolist(), strict=True)) / min(len(a), len(b))


@lazy_pandas_udf("double")
def sketch_similarity_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else sketch_similarity(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def sketch_distance(a: list[int], b: list[int]) -> float:
    return 1 - sketch_similarity(a, b)


def prefix_sketch_column(k: int, size: int):
    """f(sequence) -> `seq.sketch` by the first four letters of k-mers, for ASCII; null for other letters."""

    @F.pandas_udf("array<bigint>")
    def run(sequence: pd.Series) -> pd.Series:
        out = []
        for s in sequence:
            if s is None or not s.isascii():
                out.append(None)
                continue
            letters, n = np.frombuffer(s.encode(), np.uint8).astype(np.int64), max(len(s) - k, 0)
            values = np.zeros(n, np.int64)
            for i in range(min(k, 4)):
                values = values << 8 | letters[i : i + n]
            if n >= size:
                out.append(np.sort(np.partition(values, size - 1)[:size] if size else values[:0]))
            else:
                out.append(np.concatenate([values, np.zeros(size - n, np.int64)]))
        return pd.Series(out, dtype=object)

    return run
