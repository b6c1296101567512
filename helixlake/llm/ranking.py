"""Quality classifier by Bradley-Terry ranking.

A document's worth is a linear function of features of its text. Preference pairs (a row of label 1 over a row of label
0) give the weights by logistic loss on feature differences; the threshold is the quantile of the worths that leaves below
it the share of rows of label 0. A score is the logistic value of the distance from that threshold, shifted so that the
threshold scores 0.3.

All labelled rows count, however many there are: means, scales, the rows of label 0 and the quantile are those of all rows,
and each row is in pairs. Rows are dealt into groups by hash, and paired inside them; rows of the rarer label go into as
many groups as it takes for every group to have some. The groups hold features alone. Tasks send sums: a Newton step
is a pass over the groups, the quantile is found by counting worths in ever smaller bins.

Defined results: a null or empty text has the features of an empty text and gets a score as well; repeated rows get
equal scores; a null doc_id belongs to the fold of an empty id; without labelled rows of both classes all score 0.5; an
empty table gives no rows. Input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, buckets, fold, forget, lean, segments, slices, table, text_bytes, window_hashes, word_hashes, word_spans, written

#: Preference pairs for each row of the commoner label.
PAIRS = 4
#: Rows of the commoner label in a group, about; rows of the rarer label, at least, where there are so many.
GROUP, RARER = 2048, 64
#: Bins for a pass of the quantile's search, and worths that are sent to the driver, about, when it ends.
BINS, FEW = 1024, 10_000
THRESHOLD = 0.3

_BYTES = np.arange(256)
_CLASSES = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "symbol": np.isin(_BYTES, [ord(c) for c in "#*$%&|<>{}=_~^\\@"]),
    "shout": np.isin(_BYTES, [ord("!"), ord("?")]),
    "stop": np.isin(_BYTES, [ord("."), ord(",")]),
}
FEATURES = ("words", "chars_per_word", *(f"{k}_{x}" for k in _CLASSES for x in ("share", "log")), "repeat_share", "echo_share", "echo_log", "distinct_share")


def features(column: pa.Array) -> np.ndarray:
    """A row of features for each text."""
    raw, offsets = text_bytes(column)
    starts, ends, first = word_spans(raw, offsets)
    n = np.diff(first)
    some = np.maximum(n, 1)
    out = [np.log1p(n), np.add.reduceat(np.append(ends - starts, 0), np.minimum(first[:-1], len(starts)))[: len(n)] * (n > 0) / some if len(n) else n]
    total = np.concatenate(([0], np.cumsum(raw != 32)))
    solid = np.maximum(total[offsets[1:]] - total[offsets[:-1]], 1)
    for mask in _CLASSES.values():
        seen = np.concatenate(([0], np.cumsum(mask[raw])))
        k = seen[offsets[1:]] - seen[offsets[:-1]]
        out += [k / solid, np.log1p(k)]
    words = word_hashes(raw, starts, ends)
    doc = segments(first)
    same = np.zeros(len(words) + 1, np.int64)
    if len(words) > 1:
        same[2:] = np.cumsum((words[1:] == words[:-1]) & (doc[1:] == doc[:-1]))
    echo = same[first[1:]] - same[np.minimum(first[:-1] + 1, len(words))]
    echo = np.where(n > 0, echo, 0)
    windows = window_hashes(words, 5)
    inside = doc[: len(windows)] == doc[4:] if len(windows) else np.zeros(0, bool)
    key = np.stack([doc[: len(windows)][inside].astype(np.uint64), windows[inside]]) if len(windows) else np.zeros((2, 0), np.uint64)
    order = np.lexsort(key[::-1])
    d, w = key[0][order], key[1][order]
    again = np.bincount(d[1:][(d[1:] == d[:-1]) & (w[1:] == w[:-1])].astype(np.int64), minlength=len(n)) if len(d) else np.zeros(len(n))
    order = np.lexsort((words, doc))
    d, w = doc[order], words[order]
    distinct = np.bincount(d[np.concatenate(([True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])))] if len(d) else d, minlength=len(n))
    out += [again / some, echo / some, np.log1p(echo), distinct / some]
    return np.stack(out, axis=1).astype(np.float64)


def paired(good: np.ndarray, bad: np.ndarray, pairs: int, seed: int) -> np.ndarray:
    """Feature differences; each row of the commoner side is in `pairs` of them, the others as evenly as can be."""
    if not len(good) or not len(bad):
        return np.empty((0, good.shape[1]))
    k = pairs * max(len(good), len(bad))
    one, other = np.arange(k), np.random.default_rng(seed).permutation(k)
    return good[one % len(good)] - bad[other % len(bad)] if len(good) >= len(bad) else good[other % len(good)] - bad[one % len(bad)]


def loss_sums(diff: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number, gradient and Hessian of the logistic loss of feature differences, in one run."""
    p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
    return np.concatenate([[len(diff)], diff.T @ (p - 1), ((diff * (p * (1 - p))[:, None]).T @ diff).reshape(-1)])


def newton(sums: Callable[[np.ndarray], np.ndarray], width: int, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights with the least loss; sums gives loss_sums of all pairs for some weights."""
    w = np.zeros(width)
    for _ in range(steps):
        s = sums(w)
        step = np.linalg.solve(s[1 + width :].reshape(width, width) / s[0] + ridge * np.eye(width), s[1 : 1 + width] / s[0] + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def bradley_terry(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 42, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights that make rows of label 1 win their pairs: Newton steps on logistic loss of feature differences."""
    diff = paired(x[label == 1], x[label == 0], pairs, seed)
    return newton(lambda w: loss_sums(diff, w), x.shape[1], ridge, steps)


def moments(x: np.ndarray) -> np.ndarray:
    """Number, mean and sum of squared distances of each column."""
    n, mean = len(x), x.mean(0) if len(x) else np.zeros(x.shape[1])
    return np.stack([np.full(x.shape[1], float(n)), mean, ((x - mean) ** 2).sum(0)])


def merged(parts: list[np.ndarray]) -> np.ndarray:
    """moments() of all rows from those of parts."""
    n, mean, square = np.stack(parts, axis=1)
    total = n.sum(0)
    middle = (n * mean).sum(0) / np.maximum(total, 1)
    return np.stack([total, middle, square.sum(0) + (n * (mean - middle) ** 2).sum(0)])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def each_task(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> list[np.ndarray]:
    """The numbers that run makes of the rows of each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"v": pa.array([np.asarray(run(batches), "<f8").tobytes()], pa.binary())})

    return [np.frombuffer(r.v, "<f8") for r in rows.mapInArrow(lean(task), "v binary").collect()]


def _grouped(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.combine_chunks()
    label, x = rows["label"].to_numpy(), matrix(rows["x"].combine_chunks())
    order = np.argsort(rows["at"].to_numpy(), kind="stable")
    label, x = label[order], x[order]
    return pa.table({"number": pa.array([key[0].as_py()], pa.int64()), "good": pa.array([x[label == 1].tobytes()], pa.binary()), "bad": pa.array([x[label == 0].tobytes()], pa.binary())})


def groups(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """rows (label, x, at) in groups to be paired: number, features of label 1, of label 0."""
    n = -(-max(good, bad) // GROUP)
    copies = min(n, -(-RARER * n // min(good, bad)))
    rare = F.col("label") == (1 if good < bad else 0)
    dealt = rows.where("label in (0, 1)").withColumn("copy", F.explode(F.when(rare, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))))
    dealt = dealt.select(F.pmod(F.pmod("at", F.lit(n)) + F.col("copy"), F.lit(n)).cast("long").alias("number"), "label", "x", "at")
    return dealt.repartition(min(n, buckets(rows.sparkSession)), "number").groupBy("number").applyInArrow(_grouped, "number long, good binary, bad binary")


def quantile(rows: DataFrame, worth: Callable[[pa.RecordBatch], np.ndarray], n: int, share: float, low: float, high: float) -> float:
    """np.quantile of the worths of all rows, which are n from low to high: bins until few are left, then those."""
    place = share * (n - 1)
    k = int(place)

    def binned(edges: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(len(edges) + 1)
            for batch in batches:
                out += np.bincount(np.searchsorted(edges, worth(batch), side="right"), minlength=len(out))
            return out

        return run

    def between(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        """Worths below low, the least one above high; values from low to high and their counts."""
        v = np.concatenate([np.empty(0), *map(worth, batches)])
        values, counts = np.unique(v[(v >= low) & (v <= high)], return_counts=True)
        return np.concatenate([[(v < low).sum(), v[v > high].min(initial=np.inf)], values, counts])

    left = n
    while left > FEW:
        edges = np.unique(np.linspace(low, high, BINS + 1))
        count = np.sum(each_task(rows, binned(edges)), axis=0)
        bin_ = int(np.searchsorted(np.cumsum(count), k, side="right"))  # from edge bin_ - 1 to before edge bin_
        before = low, high
        low, high = float(edges[max(bin_ - 1, 0)]), float(edges[min(bin_, len(edges) - 1)])
        left = int(count[bin_])
        if (low, high) == before:  # equal worths
            break
    found = each_task(rows, between)
    values = np.concatenate([f[2 : 2 + (len(f) - 2) // 2] for f in found])
    counts = np.concatenate([f[2 + (len(f) - 2) // 2 :] for f in found])
    order = np.argsort(values)
    values, upto = values[order], sum(f[0] for f in found) + np.cumsum(counts[order])
    first, second = (float(values[j]) if (j := int(np.searchsorted(upto, r, side="right"))) < len(values) else min(f[1] for f in found) for r in (k, min(k + 1, n - 1)))
    return first + (second - first) * (place - k)


def learned(rows: DataFrame, labels: DataFrame, train: F.Column | None = None, label: str = "quality") -> dict:
    """The model, from featured() rows and labels."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = (known.where(train) if train is not None else known).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    both = rows.join(known.hint("merge"), "doc_id").withColumn("at", F.xxhash64("doc_id", "label", "x"))
    # rows that are equal in all go to groups of their own as well
    number = F.row_number().over(W.partitionBy("at").orderBy("doc_id"))
    both = written(both.withColumn("at", F.xxhash64("at", number)).select("label", "x", "at"))
    width = len(FEATURES)

    def looked(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        parts, seen = [np.zeros((3, width))], np.zeros(2)
        for batch in batches:
            parts.append(moments(matrix(batch.column("x"))))
            y = batch.column("label").to_numpy()
            seen += (y == 1).sum(), (y == 0).sum()
        return np.concatenate([seen, merged(parts).reshape(-1)])

    parts = each_task(both, looked)
    good, bad = (int(sum(p[k] for p in parts)) for k in range(2))
    if not good or not bad:
        forget(both)
        return {}
    n, mean, square = merged([p[2:].reshape(3, width) for p in parts])
    n, scale = int(n[0]), np.maximum(np.sqrt(square / n[0]), 1e-6)
    pairs = written(groups(both, good, bad))

    def stepped(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(1 + width + width * width)
            for batch in batches:
                for number, *sides in zip(batch.column("number").to_pylist(), batch.column("good"), batch.column("bad"), strict=True):
                    out += loss_sums(paired(*(np.frombuffer(x.as_py(), "<f8").reshape(-1, width) / scale for x in sides), PAIRS, number), w)
            return out

        return np.sum(each_task(pairs, run), axis=0)

    w = newton(stepped, width)
    worth = lambda batch: (matrix(batch.column("x")) - mean) / scale @ w

    def spread(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        parts, ends = [np.zeros((3, 1))], [np.inf, -np.inf]
        for batch in batches:
            v = worth(batch)
            parts.append(moments(v[:, None]))
            ends = [v.min(initial=ends[0]), v.max(initial=ends[1])]
        return np.concatenate([ends, merged(parts).reshape(-1)])

    parts = each_task(both, spread)
    deviation = float(np.sqrt(merged([p[2:].reshape(3, 1) for p in parts])[2, 0] / n))
    cut = quantile(both, worth, n, bad / n, min(p[0] for p in parts), max(p[1] for p in parts))
    forget(both, pairs)
    return {"mean": mean.tolist(), "scale": scale.tolist(), "weights": w.tolist(), "cut": cut, "slope": 1 / max(deviation / 4, 1e-6)}


def fit(docs: DataFrame, labels: DataFrame, train: F.Column | None = None, label: str = "quality") -> dict:
    """Mean, scale, weights, threshold, slope; plain lists."""
    rows = written(featured(docs))
    model = learned(rows, labels, train, label)
    forget(rows)
    return model


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, x: the features."""
    bounded(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_feature_rows), "doc_id long, x array<double>")


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            x = features(part.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.reshape(-1)))})


def score(x: np.ndarray, model: dict) -> np.ndarray:
    if not model:
        return np.full(len(x), 0.5)
    worth = (x - np.array(model["mean"])) / np.array(model["scale"]) @ np.array(model["weights"])
    return 1 / (1 + np.exp(-np.clip((worth - model["cut"]) * model["slope"] + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score."""
    return weighed(featured(docs), model)


def weighed(rows: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of featured() rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": score(matrix(batch.column("x")), model)})

    return rows.mapInArrow(lean(run), "doc_id long, score double")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(featured(table(spark, sf_dir, "documents")))
    model = learned(rows, table(spark, sf_dir, "labels"), fold(5) != 0)
    return weighed(rows, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
