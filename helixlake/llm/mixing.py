"""Mixing sources to target weights, by blocks.

All words of a source form one stream (documents in the order of a hash of their id), cut into blocks of a fixed number
of words. Targets come from weights; a source's slots are as many block draws as its target asks for. Each output shard
draws its source counts from a multinomial over what the sources still have to give, so that totals are met. A slot
number is mapped to a block by a pseudorandom permutation of the source's blocks (a Feistel network with cycle walking;
another one for each epoch), and blocks are joined with slots by (source, block). The last, shorter block of a source
ends each epoch, and the last slot of a source is cut to the words that its target still asks for.

Defined results: a null text has size 0 and nothing to take; a null source is a source of its own, after all others; a
null doc_id is placed by its text; repeated rows are documents of their own; an empty table gives no rows. Columns of
the input named like the results are ignored. Sources are categories with a weight each, so they are planned on the
driver; more than `MAX_SOURCES` are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, lean, mix, small, table, text_bytes, word_spans, written

BLOCK_WORDS = 64
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
EPOCHS = 2
MAX_SOURCES = 100_000
#: Hash buckets of a source's stream; each is summed up on its own.
PARTS = 1024
SLOTS_PER_SHARD = 4096
MAX_SHARDS = 100_000
#: Counts (shards x sources) that the driver draws; with more slots, shards are larger.
MAX_PLAN = 2_000_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> list[float]:
    """Words of each source: weights repeat in order, no source above `epochs` times its size, the rest shared anew."""
    total, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        scale = left / sum(w[i] for i in open_)
        above = [i for i in open_ if scale * w[i] > epochs * sizes[i]]
        for i in above:
            out[i] = float(epochs * sizes[i])
        if not above:
            for i in open_:
                out[i] = scale * w[i]
            break
        open_ -= set(above)
    return out


def slot_counts(size: int, target: float, block: int) -> tuple[int, int]:
    """Slots of a source, and the words that the last one takes."""
    words = min(round(target), EPOCHS * size)
    if not size or words <= 0:
        return 0, 0
    blocks = -(-size // block)
    epochs, rest = divmod(words, size)
    if not rest:
        return epochs * blocks, size - (blocks - 1) * block
    more = -(-rest // block)
    return epochs * blocks + more, rest - (more - 1) * block


def draw(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts (shards x sources): multinomial for each shard, over the slots that are left."""
    rng = np.random.default_rng(seed)
    left = np.array(slots, dtype=np.int64)
    out = np.zeros((shards, len(slots)), dtype=np.int64)
    for k in range(shards):
        want = int(left.sum()) // (shards - k)
        while want:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[k] += got
            left -= got
            want -= int(got.sum())
    return out


def permuted(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """k-th members of a pseudorandom permutation of 0..n-1: four Feistel rounds, walked until below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out, todo, x = np.empty(len(k), np.uint64), np.arange(len(k)), k.astype(np.uint64)
    while len(todo):
        a, b = x >> shift, x & low
        for r in range(4):
            a, b = b, a ^ (mix(b + np.uint64((key * 4 + r) & 0xFFFFFFFFFFFF), 77) & low)
        x = (a << shift) | b
        good = x < np.uint64(n)
        out[todo[good]] = x[good]
        todo, x = todo[~good], x[~good]
    return out.astype(np.int64)


def _slots(seed: int, block: int, sources: list[tuple[int, int, int]]):
    """Slots of some shards in a row. sources: blocks, slots and words of the last slot; a row has the first shard, the slots
    that each source has given before it, and the counts (shards x sources)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = np.frombuffer(row["first"], "<i8").copy()
                for shard, count in enumerate(np.frombuffer(row["counts"], "<i8").reshape(-1, len(first)), row["shard"]):
                    place = np.cumsum(count) - count
                    for src in np.flatnonzero(count).tolist():
                        (blocks, slots, last), begin, end = sources[src], int(first[src]), int(first[src] + count[src])
                        for at in range(begin, end, 1 << 18):
                            j = np.arange(at, min(at + (1 << 18), end))
                            epoch, k = np.divmod(j, blocks)
                            b = k.copy()
                            for e in np.unique(epoch):
                                inner = (epoch == e) & (k < blocks - 1)
                                b[inner] = permuted(k[inner], blocks - 1, seed * 1_000_003 + src * 101 + int(e))
                            words = np.full(len(j), block)
                            words[j == slots - 1] = last
                            yield pa.RecordBatch.from_pydict({"src": pa.array(np.full(len(j), src), pa.int32()), "block": b, "epoch": pa.array(epoch, pa.int32()), "shard": pa.array(np.full(len(j), shard), pa.int32()), "slot": j - begin + int(place[src]), "words": words})
                    first += count

    return run


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK_WORDS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces). rows: doc_id, tie, size, src, start, source_size, target. pieces: src, start, shard, slot, epoch,
    first, end (words of the document that this slot takes)."""
    spark = docs.sparkSession
    bounded(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), F.xxhash64(text).alias("tie")))
    found = small(base.groupBy("source").agg(F.sum("size").alias("size")), MAX_SOURCES, "source")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.size for r in found]
    goal = targets(sizes, weights, share)
    slots = [slot_counts(n, t, block) for n, t in zip(sizes, goal, strict=True)]
    shards = min(MAX_SHARDS, MAX_PLAN // max(1, len(slots)), max(8, sum(k for k, _ in slots) // SLOTS_PER_SHARD))
    counts = draw([k for k, _ in slots], shards, seed)
    # shards by runs, their counts as they are in memory: the driver holds no row for each shard and source
    runs = max(8, 4 * spark.sparkContext.defaultParallelism)
    width, given, plan = max(1, -(-shards // runs)), np.zeros(len(slots), np.int64), []
    for k in range(0, shards if slots else 0, width):
        part = counts[k : k + width]
        plan.append((k, given.astype("<i8").tobytes(), part.astype("<i8").tobytes()))
        given = given + part.sum(axis=0)
    sources = [(-(-n // block), *s) for n, s in zip(sizes, slots, strict=True)]
    about = spark.createDataFrame([(r.source, i, r.size, float(goal[i])) for i, r in enumerate(found)], "source string, src int, source_size long, target double")
    # the number of sources is checked above
    known = base.join(F.broadcast(about), base.source.eqNullSafe(about.source)).select("doc_id", "tie", "size", "src", "source_size", "target", F.pmod(F.xxhash64(F.coalesce("doc_id", "tie")), F.lit(PARTS)).alias("part"))
    sums = known.groupBy("src", "part").agg(F.sum("size").alias("n"))
    begins = sums.select("src", "part", (F.sum("n").over(W.partitionBy("src").orderBy("part")) - F.col("n")).alias("begin"))
    order = W.partitionBy("src", "part").orderBy("doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    rows = known.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).join(begins, ["src", "part"]).select("doc_id", "tie", "size", "src", (F.col("begin") + F.col("before")).alias("start"), "source_size", "target")
    rows = written(rows)
    cut = rows.where("size > 0").select("src", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    drawn = spark.createDataFrame(plan, "shard int, first binary, counts binary").repartition(runs).mapInArrow(lean(_slots(seed, block, sources)), "src int, block long, epoch int, shard int, slot long, words long")
    # the planner takes the slots to be as small as the counts that they are made of, and would send them all to the driver
    joined = cut.join(drawn.hint("merge"), ["src", "block"])
    begin = F.col("block") * block
    pieces = joined.select("src", "start", "shard", "slot", "epoch", (F.greatest(F.col("start"), begin) - F.col("start")).alias("first"), (F.least(F.col("start") + F.col("size"), begin + F.col("words")) - F.col("start")).alias("end"))
    return rows, pieces.where("end > first")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the taken words out of each text: whole texts unchanged, else the runs of words, a line each."""
    for batch in batches:
        out = []
        for text, size, runs in zip(batch.column("__text").to_pylist(), batch.column("__size").to_pylist(), batch.column("__runs").to_pylist(), strict=True):
            spans: list[list[int]] = []
            for r in sorted(runs, key=lambda r: r["first"]):
                if spans and spans[-1][1] >= r["first"]:
                    spans[-1][1] = max(spans[-1][1], r["end"])
                else:
                    spans.append([r["first"], r["end"]])
            if spans == [[0, size]]:
                out.append(text)
                continue
            raw, offsets = text_bytes(pa.array([text]))
            starts, ends, _ = word_spans(raw, offsets)
            whole = raw.tobytes()
            out.append("\n".join(whole[starts[a] : ends[b - 1]].decode() for a, b in spans))
        yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(out, pa.string())], names=["__row", "__new"])


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """Documents of the mix, with all columns of docs: a row for each document and epoch, its text the words taken.

    n_chars, where there is one, is set anew.
    """
    rows, pieces = mixture(docs, **kw)
    taken = pieces.groupBy("src", "start", "epoch").agg(F.collect_list(F.struct("first", "end")).alias("runs")).join(rows.where("size > 0").select("src", "start", "doc_id", "tie", "size"), ["src", "start"])
    # equal rows (doc_id, tie) share what they take; numbered, each takes its own
    number = W.partitionBy("doc_id", "tie").orderBy("src", "start")
    ids = rows.where("size > 0").select("src", "start", F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), F.row_number().over(number).alias("__copy"))
    taken = taken.select("src", "start", "epoch", "runs", "size").join(ids, ["src", "start"])
    text = F.coalesce(F.col("text"), F.lit(""))
    mine = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__id"), F.xxhash64(text).alias("__tie"), F.col("source").cast("string").alias("__source"), text.alias("__text"))
    mine = mine.withColumn("__copy", F.row_number().over(W.partitionBy("__id", "__tie").orderBy(F.col("__source").asc_nulls_last())))
    both = mine.join(taken, mine["__id"].eqNullSafe(taken["__id"]) & (mine["__tie"] == taken["__tie"]) & (mine["__copy"] == taken["__copy"]))
    cut = both.select("__row", "__text", F.col("size").alias("__size"), F.col("runs").alias("__runs"))
    row = docs.select(F.struct(*docs.columns).alias("__row")).schema["__row"].dataType.simpleString()
    made = cut.mapInArrow(lean(_texts), f"__row {row}, __new string")
    new = {"text": F.col("__new"), "n_chars": F.char_length("__new").cast("long")}
    return made.select(*(new[c].alias(c) if c in new else F.col("__row").getField(c).alias(c) for c in docs.columns))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pieces = mixture(table(spark, sf_dir, "documents"))
    taken = pieces.groupBy("src", "start").agg(F.sum(F.col("end") - F.col("first")).alias("taken"))
    some = rows.where("size > 0").join(taken, ["src", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return some.unionByName(rows.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))
