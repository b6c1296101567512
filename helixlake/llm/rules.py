"""Quality rules: a decision list learned by sequential covering, with DataFrame functions only.

Statistics of each whole text are Spark expressions. On a bounded sample of labelled rows the driver grows conjunctions
of thresholds (FOIL gain) on two thirds and prunes them on the rest, rule after rule, each on what the rules before it
leave. The list becomes an ordered conditional expression, which Spark evaluates for every row.

Defined results: a null or empty text has no words, so base_failed is true and kept false; repeated rows are judged
each for itself; a null doc_id passes through; with no labelled rows or only one class the list is empty and keeps all
that pass the base rules; an empty table gives no rows. Input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, labelled_sample, table, words_of

#: Labelled rows that the list is learned from, at most.
SAMPLE = 8000
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: A rule has to be right on this share of the rows it covers.
PRECISION = 0.95

#: What rules may ask about, as SQL over the statistics.
FEATURES = {
    "symbols_per_word": "try_divide(n_symbols, n_words)",
    "repeat_share": "try_divide(n_repeat_words, n_words)",
    "dup_lines": "n_dup_lines",
    "upper_share": "try_divide(n_upper, word_chars)",
    "shouts_per_word": "try_divide(n_shouts, n_words)",
    "digit_share": "try_divide(n_digits, word_chars)",
    "echo_share": "try_divide(n_echoes, n_words)",
}


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with one computation of value: lambdas see it through an array of one element, also where the optimizer
    puts the whole expression into a filter."""
    return F.get(F.transform(F.array(value), f), 0)


def window_hashes(words: Column) -> Column:
    """A hash for each place where a window of 5 words begins."""
    span = F.sequence(F.lit(0), F.greatest(F.size(words) - WINDOW, F.lit(0)))
    hashes = F.transform(span, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))
    return F.when(F.size(words) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def repeat_words(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more, from the hashes of the windows at each word."""
    placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    near = lambda s: F.transform(s, lambda v, k: F.when((v.x == F.get(s, k - 1).x) | (v.x == F.get(s, k + 1).x), v.i))
    at = lambda s: F.sort_array(F.filter(near(s), lambda i: i.isNotNull()))
    gaps = lambda q: F.aggregate(F.transform(q, lambda p, k: F.coalesce(F.least(F.lit(WINDOW), F.get(q, k + 1) - p), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
    some = once(placed, lambda s: once(at(s), gaps))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), some).otherwise(0).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id (and label, where there is one), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and more counts."""
    keep = [c for c in ("doc_id", "label") if c in docs.columns]
    text = docs.select(*keep, F.coalesce("text", F.lit("")).alias("t"))
    split = text.select(*keep, "t", words_of("t").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("long")
    return split.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("t", WS + "+", "")).cast("long").alias("word_chars"),
        count(f"[{SYMBOLS}]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        once(F.col("w"), lambda w: once(window_hashes(w), repeat_words)).alias("n_repeat_words"),
        count(r"\p{Lu}").alias("n_upper"),
        count("!").alias("n_shouts"),
        count("[0-9]").alias("n_digits"),
        once(F.col("w"), lambda w: F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1)))).cast("long").alias("n_echoes"),
    )


Condition = tuple[str, str, float]


def covers(rule: list[Condition], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for name, op, value in rule:
        out &= x[name] >= value if op == ">=" else x[name] <= value
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[Condition]:
    """Adds the condition of the greatest FOIL gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < most and inside.any() and (~bad[inside]).any():
        p0 = bad[inside].sum()
        best, chosen = 0.0, None
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            cuts = np.flatnonzero(np.diff(v) > 0) + 1
            if not len(cuts):
                continue
            below = np.concatenate(([0], np.cumsum(b)))
            for op, p, n in (("<=", below[cuts], cuts), (">=", p0 - below[cuts], len(v) - cuts)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / n) - math.log2(p0 / len(v))), 0)
                k = int(np.argmax(gain))
                if gain[k] > best + 1e-9:
                    best, chosen = float(gain[k]), (name, op, float((v[cuts[k] - 1] + v[cuts[k]]) / 2))
        if chosen is None:
            break
        rule.append(chosen)
        inside &= covers([chosen], x)
    return rule


def prune(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """The beginning of the rule with the best (p - n) / (p + n) on rows that it was not grown on."""
    best, out = -2.0, rule
    for k in range(1, len(rule) + 1):
        hit = covers(rule[:k], x)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        value = (p - n) / (p + n) if p + n else -1.0
        if value > best + 1e-12:
            best, out = value, rule[:k]
    return out


def decision_list(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = PRECISION, most: int = 4, rules: int = 24) -> list[list[Condition]]:
    """Sequential covering: rules for bad rows, each learned on what those before it leave."""
    out: list[list[Condition]] = []
    left = np.ones(len(bad), dtype=bool)
    third = np.arange(len(bad)) % 3 == 2
    while len(out) < rules and (left & bad).sum() >= 3:
        cut = lambda m: {k: v[m] for k, v in x.items()}  # noqa: B023, E731
        rule = grow(cut(left & ~third), bad[left & ~third], most)
        if not rule:
            break
        rule = prune(rule, cut(left & third), bad[left & third])
        hit = covers(rule, x) & left
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p < 3 or p < precision * (p + n):
            break
        out.append(rule)
        left &= ~hit
    return out


def expression(rules: list[list[Condition]]) -> Column:
    """The list as an ordered conditional: false from the first rule that holds, else true."""
    out = F.lit(True)
    for rule in reversed(rules):
        hold = F.lit(True)
        for name, op, value in rule:
            v = F.coalesce(F.expr(FEATURES[name]).cast("double"), F.lit(0.0))
            hold = hold & (v >= value if op == ">=" else v <= value)
        out = F.when(hold, F.lit(False)).otherwise(out)
    return out


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> list[list[Condition]]:
    rows = statistics(labelled_sample(docs, labels, label, None, sample)).select("doc_id", "label", *(F.coalesce(F.expr(v).cast("double"), F.lit(0.0)).alias(k) for k, v in FEATURES.items())).collect()
    if len({r.label for r in rows}) < 2:
        return []
    rows.sort(key=lambda r: (hash((r.doc_id, 7)) & 0xFFFFFFFF, r.doc_id))
    return decision_list({k: np.array([r[k] for r in rows]) for k in FEATURES}, np.array([r.label == 0 for r in rows]))


def judged(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Statistics, base_failed, kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return statistics(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & expression(rules))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = learn(docs, table(spark, sf_dir, "labels"))
    return judged(docs.select("doc_id", "text"), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
