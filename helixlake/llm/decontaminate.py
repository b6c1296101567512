"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

Texts are lower-cased (A-Z only) and cut into words of digits, letters and all code points from U+0080 on. Every item
gives its windows of `width` following words (an item of fewer words, but not none, is one window). The automaton holds
all windows; each text is scanned once, and hits are mapped back to word numbers and to offsets of the original text.

Defined results: a null or empty text has no words and no hits; a null item has no words; items with equal ids count as
one item; a null item_id takes part as the string "null"; repeated documents are scanned each for itself; an empty
benchmark hits nothing; a text of any length is scanned whole. Columns other than the named ones pass through.

The windows of the test items are broadcast. Their number is checked: up to `block_windows` of them make one automaton;
a larger benchmark is scanned in several passes, one automaton after the other, and the hits of a row are united by a key
that is written with the texts before the first pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, kept, lean, table, text_bytes, written

WIDTH = 8
#: Windows in one automaton (about 200 bytes each).
BLOCK_WINDOWS = 500_000

_WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32 for b in range(256))
_IN_WORD = np.frombuffer(_WORD_BYTES, dtype=np.uint8) != 32


def normal_words(text: str | None) -> list[str]:
    return [w for w in text.encode("utf-8").translate(_WORD_BYTES).decode("utf-8").split(" ") if w] if text else []


def item_windows(text: str | None, width: int = WIDTH) -> list[str]:
    words = normal_words(text)
    return [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def automaton(items: list[tuple[str, str]], width: int) -> tuple[ahocorasick.Automaton, list[tuple[int, tuple[str, ...]]]]:
    """Built once in each worker: windows between spaces, and for each window its number of words and its items."""

    def build() -> tuple[ahocorasick.Automaton, list]:
        owners: dict[str, set[str]] = {}
        for item, text in items:
            for w in item_windows(text, width):
                owners.setdefault(w, set()).add(item)
        made, values = ahocorasick.Automaton(), []
        for w, ids in owners.items():
            made.add_word(f" {w} ", len(values))
            values.append((w.count(" ") + 1, tuple(sorted(ids))))
        if values:
            made.make_automaton()
        return made, values

    return kept(("automaton", hashlib.sha256(repr((items, width)).encode()).hexdigest()), build)


def scan(text: str | None, made: ahocorasick.Automaton, values: list) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit runs of words (first, end; in order, apart from each other), items."""
    if not text:
        return 0, [], set()
    plain = b" ".join(text.encode("utf-8").translate(_WORD_BYTES).split())
    n = plain.count(b" ") + 1 if plain else 0
    if not n or not values:
        return n, [], set()
    hay = f" {plain.decode('utf-8')} "
    runs, items, seen, word, at = [], set(), set(), 0, 0
    for end, value in made.iter(hay):  # in order of `end`, which stands on the space after the window
        word += hay.count(" ", at, end)
        at = end
        width, ids = values[value]
        first, last = word - width, word
        if value not in seen:
            seen.add(value)
            items.update(ids)
        while runs and runs[-1][1] >= first:
            before = runs.pop()
            first, last = min(first, before[0]), max(last, before[1])
        runs.append((first, last))
    return n, runs, items


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code point offsets of the original text."""
    raw, offsets = text_bytes(pa.array([text]))
    inside = _IN_WORD[raw]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in runs]


def _scanner(shared, width: int, keep: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, values = automaton(shared.value, width)
        for batch in batches:
            n, hit, runs, spans, items = [], [], [], [], []
            for text in batch.column("__text").to_pylist():
                words, found, ids = scan(text, made, values)
                n.append(words)
                hit.append(sum(b - a for a, b in found))
                runs.append([{"first": a, "end": b} for a, b in found])
                spans.append([{"start": a, "end": b} for a, b in char_spans(text, found)] if found else [])
                items.append(sorted(ids))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(v, schema.field(k).type) for k, v in (("n_words", n), ("n_hit", hit), ("hit_words", runs), ("hit_spans", spans), ("items", items)))], schema=pa.schema([*(batch.schema.field(c) for c in keep), *(schema.field(k) for k in ("n_words", "n_hit", "hit_words", "hit_spans", "items"))]))

    return run


_OUT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit_words", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("hit_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
_OUT_DDL = "n_words long, n_hit long, hit_words array<struct<first:long,end:long>>, hit_spans array<struct<start:long,end:long>>, items array<string>"


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns of docs, then n_words, n_hit, hit_words, hit_spans, items."""
    bounded(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.char_length("text")).alias("n"), F.count("*").alias("rows")).first()
    blocks = max(1, -(-int(size.n or 0) // max(1, 2 * block_windows)))  # a word has two characters and more with its space
    rows, named = docs.select(*keep, F.col("text").alias("__text")), list(keep)
    if blocks > 1:  # each row gets a key of its own, written once, so that all passes name it alike
        rows, named = written(rows.withColumn("__key", F.monotonically_increasing_id())), ["__key"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*named).schema)
    out = None
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        shared = docs.sparkSession.sparkContext.broadcast(sorted((r.item, r.text) for r in part.toLocalIterator()))
        made = rows.select(*named, "__text").mapInArrow(lean(_scanner(shared, width, named, _OUT)), f"{fields}, {_OUT_DDL}")
        out = made if out is None else out.unionByName(made)
    if blocks == 1:
        return out
    run, last = "struct<w:struct<first:long,end:long>,s:struct<start:long,end:long>>", lambda acc: F.element_at(acc, -1)
    wider = lambda x, y, part, a: F.struct(x[part][a].alias(a), F.greatest(x[part]["end"], y[part]["end"]).alias("end")).alias(part)
    # unites sorted runs by their words; their spans go with them
    united = F.aggregate(
        F.sort_array(F.flatten("runs")), F.array().cast(f"array<{run}>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (last(acc)["w"]["end"] >= x["w"]["first"]), F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(wider(last(acc), x, "w", "first"), wider(last(acc), x, "s", "start")))).otherwise(F.array_append(acc, x)),
    )
    pairs = F.arrays_zip(F.col("hit_words").alias("w"), F.col("hit_spans").alias("s")).cast(f"array<{run}>")
    one = out.groupBy("__key").agg(F.max("n_words").alias("n_words"), F.collect_list(pairs).alias("runs"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    one = one.select("__key", "n_words", united.alias("runs"), "items")
    one = one.select("__key", "n_words", F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x.w.end - x.w.first).alias("n_hit"), F.col("runs.w").alias("hit_words"), F.col("runs.s").alias("hit_spans"), "items")
    return rows.drop("__text").join(one, "__key").drop("__key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_items: int = 2) -> DataFrame:
    """docs without those in which windows of `least_items` items or more occur; all columns of docs."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return find(rows, benchmark, keep=("__row",)).where(F.size("items") < least_items).select("__row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


SQL = r"""
WITH b AS (
  SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(lower_a, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_a FROM benchmark)),
bw AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 7], ' ') AS win, least(len(w), 8) AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower_a, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_a FROM documents)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, dw.k AS k, item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
pos AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item)::BIGINT AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
