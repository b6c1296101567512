"""Toxicity by Levenshtein automata over a lexicon trie, and context windows.

The lexicon is learned: whole words and word beginnings that mark toxic rows in a bounded sample of labelled rows, by a
likelihood ratio that chance does not reach. The union of the Levenshtein automata of all terms is the trie of the terms
walked with edit rows; its states are made as words need them and kept, so that a known walk costs one lookup for each
letter. Words are folded first (case, marks around them, digits that stand for letters).

Every match is weighed by its distance and by the words around it: quoted terms count less than terms aimed at someone.
A logistic model over the sums turns a document into a score.

Defined results: a null or empty text has no match and gets the score of an empty text; repeated rows get equal scores;
a null doc_id belongs to the fold of an empty id; without labelled rows of both classes the lexicon is empty and all
score 0; an empty table gives no rows. Texts of any length are read whole. Other input columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, fold, kept, labelled_sample, lean, slices, table, written

#: Labelled rows that lexicon and weights are learned from, at most; terms of the lexicon, at most.
SAMPLE = 20_000
TERMS = 2000
THRESHOLD = 0.3
#: Least likelihood ratio (G) of a term; 20 is reached by chance about once in 100,000 terms.
LEAST_G = 20.0
PREFIX = range(4, 9)
CONTEXT = 4
#: States that a worker keeps before it starts anew.
STATES = 200_000

_EDGE = " \t\"'`.,;:!?()[]{}<>«»„“”‘’*_~-"
_OPEN, _CLOSE = set("\"'«„“‘`("), set("\"'»”’`)")
#: Digits and signs that stand for letters (fixed values).
_LETTERS = str.maketrans("0134578@$", "oieastbas")
#: Words that report speech, and words that address someone (fixed values).
_REPORT = frozenset("said says called calls wrote writes word term quote quoted dit disait mot sagte sagt wort dijo dice palabra".split())
_ADDRESS = frozenset("you your you're youre ur u tu te toi vous du dich ihr usted eres are".split())


def folded(word: str) -> str:
    word = word.lower().strip(_EDGE)
    return word if word.isdigit() else word.translate(_LETTERS)


def edits(length: int) -> int:
    """Edits that a term of this length allows."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Lexicon:
    """Trie of terms with lazily made states of the union of their Levenshtein automata.

    A state is a set of (trie node, row of edit distances); two states that are equal are one. A term that ends in * is
    matched by every word that begins with it.
    """

    def __init__(self, terms: list[str]):
        self.terms = sorted(set(terms))
        self.nodes: list[list] = [[{}, -1, -1, 0]]  # children, whole term, beginning, depth
        self.most: list[int] = [0]
        for k, term in enumerate(self.terms):
            at = 0
            for c in term.removesuffix("*"):
                kids = self.nodes[at][0]
                if c not in kids:
                    kids[c] = len(self.nodes)
                    self.nodes.append([{}, -1, -1, self.nodes[at][3] + 1])
                    self.most.append(0)
                at = kids[c]
            self.nodes[at][2 if term.endswith("*") else 1] = k
        self.reach(0)
        self.reset()

    def reach(self, root: int) -> None:
        """For each node the most edits that a term below it allows."""
        order, at = [root], 0
        while at < len(order):
            order.extend(self.nodes[order[at]][0].values())
            at += 1
        for n in reversed(order):
            kids, term, _, depth = self.nodes[n]
            self.most[n] = max([edits(depth) if term >= 0 else 0, *(self.most[k] for k in kids.values())])

    def reset(self) -> None:
        start = self.closed({0: 0})
        self.states: dict[frozenset, int] = {start: 0}
        self.sets: list[frozenset] = [start]
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, int] | None] = [None]
        self.begun: list[tuple[int, int] | None] = [None]

    def closed(self, reached: dict[int, int]) -> frozenset:
        """Adds what leaving out letters of a term reaches."""
        todo = list(reached.items())
        while todo:
            node, d = todo.pop()
            if reached.get(node, 99) < d:
                continue
            for kid in self.nodes[node][0].values():
                if d + 1 <= self.most[kid] and reached.get(kid, 99) > d + 1:
                    reached[kid] = d + 1
                    todo.append((kid, d + 1))
        return frozenset(reached.items())

    def accepts(self, state: frozenset, begun: bool = False) -> tuple[int, int] | None:
        """The nearest whole term that the state completes, or the beginning that it has just completed."""
        best = None
        for node, d in state:
            term = self.nodes[node][2 if begun else 1]
            if term >= 0 and d <= (0 if begun else edits(self.nodes[node][3])) and (best is None or (d, term) < best):
                best = (d, term)
        return best

    def step(self, at: int, c: str) -> int:
        reached: dict[int, int] = {}

        def put(node: int, d: int) -> None:
            if d <= self.most[node] and reached.get(node, 99) > d:
                reached[node] = d

        for node, d in self.sets[at]:
            put(node, d + 1)  # an extra letter of the word
            for x, kid in self.nodes[node][0].items():
                put(kid, d + (x != c))
        for node, d in self.sets[at]:
            kid = self.nodes[node][0].get(c)
            if kid is not None and d == 0:
                reached[kid] = 0
        state = self.closed(reached)
        if state not in self.states:
            self.states[state] = len(self.sets)
            self.sets.append(state)
            self.next.append({})
            self.ends.append(self.accepts(state))
            self.begun.append(self.accepts(state, begun=True))
        return self.states[state]

    def find(self, word: str) -> tuple[int, int] | None:
        """(distance, term) of the best term: the whole word, else the longest beginning, else the nearest; None without one."""
        at, stem = 0, None
        for c in word:
            to = self.next[at].get(c)
            if to is None:
                to = self.next[at][c] = self.step(at, c)
            at = to
            stem = self.begun[at] if self.begun[at] is not None else stem
            if not self.sets[at]:
                break
        end = self.ends[at]
        if len(self.sets) > STATES:
            self.reset()
        return end if end is not None and (end[0] == 0 or stem is None) else stem


def candidates(word: str) -> list[str]:
    w = folded(word)
    return [w, *(w[:n] + "*" for n in PREFIX if n < len(w))] if len(w) >= 4 else []


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a term, summed in each batch."""
    for batch in batches:
        n: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            n[1 if label == 1 else 0].update({t for w in set(text.split()) for t in candidates(w)})
        terms = list(n[0].keys() | n[1].keys())
        for at in range(0, len(terms), 50_000):
            part = terms[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"term": part, "bad": pa.array([n[1][t] for t in part], pa.int64()), "good": pa.array([n[0][t] for t in part], pa.int64())})


def lexicon(sample: DataFrame) -> list[tuple[str, float]]:
    """Terms and their log-odds: likelihood ratio of LEAST_G or more, most rows toxic; of nested terms that mark the same
    rows, the longest."""
    size = {r.label: r.n for r in sample.groupBy((F.col("label") == 1).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return []
    rate = size[1] / (size[0] + size[1])
    total = F.col("bad") + F.col("good")
    share = F.col("bad") / total
    g = 2 * (F.col("bad") * F.log(share / rate) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - share) / (1 - rate))).otherwise(0.0))
    counts = sample.mapInArrow(lean(_term_counts), "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rows = counts.where((F.col("bad") > 3) & (share >= 0.5)).withColumn("g", g).where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), F.desc(F.length("term")), "term").limit(TERMS).collect()
    out = []
    for r in sorted(rows, key=lambda r: r.term):
        stem = r.term.removesuffix("*")
        if not any(o.term != r.term and o.term.removesuffix("*").startswith(stem) and len(o.term.removesuffix("*")) > len(stem) - r.term.endswith("*") and o.bad >= 0.97 * r.bad and o.good >= 0.97 * r.good for o in rows):
            out.append((r.term, math.log((r.bad + 0.5) / (r.good + 0.5) * size[0] / size[1])))
    return out


def context(words: list[str], k: int) -> tuple[float, bool]:
    """Weight of the match at word k by the words around it, and whether it is quoted."""
    near = words[max(0, k - CONTEXT) : k]
    before, after = words[k][:1], words[k].rstrip(".,;:!?")[-1:]
    opened = before in _OPEN or any(w[:1] in _OPEN and w.rstrip(".,;:!?")[-1:] not in _CLOSE for w in near)
    closed = after in _CLOSE or any(w.rstrip(".,;:!?")[-1:] in _CLOSE for w in words[k + 1 : k + 1 + CONTEXT])
    reported = any(folded(w) in _REPORT for w in near)
    aimed = any(folded(w) in _ADDRESS for w in near)
    if opened and closed:
        return 0.3 if not aimed or reported else 0.6, True
    return (1.25 if aimed else 1.0) * (0.8 if reported else 1.0), False


FEATURES = ("exact", "near", "quoted", "share", "terms", "evidence", "strongest")


def features(column: pa.Array, lexicon: list[tuple[str, float]]) -> np.ndarray:
    key = tuple(sorted(t for t, _ in lexicon))
    lex, odds = kept(("lexicon", *key), lambda: Lexicon(list(key))), [o for _, o in sorted(lexicon)]
    out = np.zeros((len(column), len(FEATURES)))
    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    codes = lists.flatten().dictionary_encode()
    hit = [lex.find(folded(w)) for w in codes.dictionary.to_pylist()]
    known = np.array([h is not None for h in hit], dtype=bool)
    index = codes.indices.to_numpy()
    at = np.flatnonzero(known[index]) if len(index) else np.empty(0, np.int64)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
    doc = np.searchsorted(offsets, at, side="right") - 1
    length = np.maximum(np.diff(offsets), 1)
    for d in np.unique(doc):
        mine = at[doc == d]
        lo, hi = offsets[d], offsets[d + 1]
        seen: dict[int, float] = {}
        for k in mine:
            a, b = max(lo, k - CONTEXT), min(hi, k + CONTEXT + 1)
            words = codes.dictionary.take(codes.indices[a:b]).to_pylist()
            weight, quoted = context(words, int(k - a))
            distance, term = hit[index[k]]
            seen[term] = max(seen.get(term, 0.0), odds[term] * weight / (1 + 2 * distance))
            out[d, 0 if distance == 0 else 1] += 0 if quoted else weight
            out[d, 2] += weight if quoted else 0
            out[d, 3] += weight / (1 + distance)
        out[d, 4] = len(seen)
        out[d, 5], out[d, 6] = sum(seen.values()), max(seen.values())
    out[:, 3] = out[:, 3] / length * 100
    out[:, :5] = np.log1p(out[:, :5])
    out[:, 5:] /= 4
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights, the last one the constant; Newton steps with a ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w)), x.T @ (p - y) / len(y) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train: F.Column | None = None, label: str = "toxic", sample: int = SAMPLE) -> dict:
    """Terms and weights."""
    bounded(docs.sparkSession)
    rows = written(labelled_sample(docs, labels, label, train, sample))
    terms = lexicon(rows)
    if not terms:
        return {"terms": [], "weights": []}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict({"label": part.column("label"), "x": pa.array(list(features(part.column("text"), terms)), pa.list_(pa.float64()))})

    found = rows.select("label", "text").mapInArrow(lean(run), "label int, x array<double>").groupBy("x", "label").agg(F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r.x, r.label))
    x, y = np.repeat([r.x for r in found], [r.n for r in found], axis=0), np.repeat([r.label == 1 for r in found], [r.n for r in found]).astype(float)
    return {"terms": terms, "weights": logistic(x, y).tolist()}


def score(column: pa.Array, model: dict) -> np.ndarray:
    if not model["terms"]:
        return np.zeros(len(column))
    w = np.array(model["weights"])
    return 1 / (1 + np.exp(-np.clip(features(column, model["terms"]) @ w[:-1] + w[-1], -40, 40)))


def scored(docs: DataFrame, model: dict, keep: str = "doc_id") -> DataFrame:
    """The kept column, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(keep), pa.array(score(part.column("text"), model))], names=[keep, "score"])

    kind = docs.schema[keep].dataType.simpleString()
    bounded(docs.sparkSession)
    return docs.select(keep, "text").mapInArrow(lean(run), f"{keep} {kind}, score double")


def clean(docs: DataFrame, model: dict) -> DataFrame:
    """docs without those that score THRESHOLD or more; all columns of docs."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return scored(rows, model, "__row").where(F.col("score") < THRESHOLD).select("__row.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), fold(4) != 2)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
