"""Substring dedup by recompression.

Words of a text are symbols. Rounds of recompression name runs of equal symbols and pairs of neighbours (a pair of a
left and a right symbol, by one bit of their hashes). Names are hashes of what they stand for, so they are the same in
all documents, without any exchange. Whether two symbols join depends on these two alone; therefore equal substrings
have equal symbols inside, up to one symbol at each end in each round, and equal borders between symbols.

Reveal. After two rounds every repeated window of WIDTH words holds a border at most 5 words from its start, unless
equal symbols stand side by side in it. The symbols that follow a border, to a length of ANCHOR words, are the anchor of
that border; windows with such a run are anchors themselves. Tasks send short prints of their distinct anchors to
ranges, with a mark on those that two of the task's documents hold; ranges send back prints that several tasks hold.

Verify. Windows without a shared anchor are done with. For the others full names (96 bits, two independent hashes) go to
ranges with the smallest document that holds them in the task, and come back with the smallest of all. A word that lies
in a window of a smaller document is removed.

A task sends each print or name once, however many documents hold it, so a passage that a third of all rows shares is
no larger for its range than the number of tasks. Chunks of documents travel as compressed blobs of a bounded size.

Defined results: a null or empty text has no words; a null doc_id is larger than any other, and such rows don't remove
from each other; rows with equal ids don't remove from each other; a text of any length is one chunk at least; an empty
table gives no rows. Input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import LAST, chunks, pack, packed, squeezed, unpack, unsqueezed
from .common import bounded, buckets, by_bucket, lean, mix, ragged, segments, table, window_hashes, word_hashes, word_spans, written

WIDTH = 13
ANCHOR = 8
#: A window without runs has a border at most so far from its start.
LATEST = 5
ROUNDS = 2


# ---- recompression


class Words:
    """Words of a chunk, with the names that recompression gives them."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw = raw
        self.starts, self.ends, self.first = word_spans(raw, offsets)
        self.doc = segments(self.first)
        self.n = len(self.starts)
        self.names = word_hashes(raw, self.starts, self.ends)

    def whole(self, at: np.ndarray, width: int) -> np.ndarray:
        """Of places, those from which `width` words of the same document follow."""
        at = at[at + width <= self.n]
        return at[self.doc[at] == self.doc[at + width - 1]]

    def borders(self) -> np.ndarray:
        """Places where a symbol of the last round begins."""
        name, at = self.names, np.arange(self.n)
        for r in range(ROUNDS):
            same = (name[1:] == name[:-1]) & (self.doc[at[1:]] == self.doc[at[:-1]])
            if same.any():  # a run becomes one symbol, named by the symbol and its count
                head = np.concatenate(([True], ~same))
                count = np.diff(np.append(np.flatnonzero(head), len(name))).astype(np.uint64)
                name, at = name[head], at[head]
                name = np.where(count > 1, mix(name + count * np.uint64(0x9E3779B97F4A7C15), 50 + r), name)
            side = (mix(name, 60 + r) >> np.uint64(63)).astype(bool)
            join = side[:-1] & ~side[1:] & (self.doc[at[1:]] == self.doc[at[:-1]])
            left = np.flatnonzero(join)
            name = name.copy()
            name[left] = mix(name[left] * np.uint64(0xD1342543DE82EF95) + name[left + 1], 70 + r)
            keep = np.ones(len(name), dtype=bool)
            keep[left + 1] = False
            name, at = name[keep], at[keep]
        return at

    def repeats(self, every: np.ndarray) -> np.ndarray:
        """Of the windows at these places, those that hold the same word, or the same two words, twice in a row."""
        x = self.names
        one = np.zeros(self.n + 1, np.int64)
        two = np.zeros(self.n + 1, np.int64)
        if self.n > 3:
            one[1:-1] = np.cumsum(x[1:] == x[:-1])
            one[-1] = one[-2]
            two[1:-3] = np.cumsum((x[2:-1] == x[:-3]) & (x[3:] == x[1:-2]))
            two[-3:] = two[-4]
        return every[(one[every + WIDTH - 1] > one[every]) | (two[every + WIDTH - 3] > two[every])] if len(every) else every

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and prints of border anchors, places and prints of the windows with a run."""
        at = self.whole(self.borders(), ANCHOR)
        short = window_hashes(self.names, ANCHOR)
        odd = self.repeats(self.whole(np.arange(self.n), WIDTH))
        full = window_hashes(self.names, WIDTH)
        return at, short[at] if len(at) else at.astype(np.uint64), odd, mix(full[odd], 5) if len(odd) else odd.astype(np.uint64)


def send(keys: np.ndarray, docs: np.ndarray, chunk: int, n: int) -> pa.RecordBatch:
    """Distinct prints by range: the lower 31 bits of each, with a mark on those that two documents of the chunk hold."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    head = np.concatenate(([True], k[1:] != k[:-1]))
    several = np.zeros(int(head.sum()), dtype=bool)
    several[(np.cumsum(head) - 1)[1:][(k[1:] == k[:-1]) & (d[1:] != d[:-1])]] = True
    k = k[head]
    bucket = by_bucket(k, n).astype(np.int64)
    print_ = (k & np.uint64(0x7FFFFFFF)).astype(np.uint32) | (several.astype(np.uint32) << np.uint32(31))
    cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, np.int64)
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[cut[:-1]], pa.int32()), "chunk": pa.array(np.full(len(cut) - 1, chunk)), "prints": pa.array([print_[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})


def _anchors(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, raw, offsets in chunks(batches):
            w = Words(raw, offsets)
            at, a, odd, b = w.anchors()
            if len(a) + len(b):
                yield send(np.concatenate([a, b]), w.doc[np.concatenate([at, odd])], number, n)

    return run


def _shared(rows: pa.Table) -> pa.Table:
    """Of one range: for each chunk the prints that another chunk holds too, or that carry the mark anywhere."""
    numbers = rows["chunk"].to_pylist()
    prints = [np.frombuffer(b.as_py(), np.uint32) for b in rows["prints"]]
    every = np.concatenate(prints)
    owner = np.repeat(np.arange(len(prints)), [len(p) for p in prints])
    bare, mark = every & np.uint32(0x7FFFFFFF), every >> np.uint32(31)
    order = np.lexsort((owner, bare))
    b, m, o = bare[order], mark[order], owner[order]
    head = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    size = np.diff(np.append(head, len(b)))
    good = np.repeat((size > 1) | (np.maximum.reduceat(m, head) > 0), size)
    o, b = o[good], b[good]
    order = np.argsort(o, kind="stable")
    o, b = o[order], b[order]
    cut = np.concatenate(([0], np.flatnonzero(np.diff(o)) + 1, [len(o)])) if len(o) else np.zeros(1, np.int64)
    return pa.table({"chunk": pa.array([numbers[o[a]] for a in cut[:-1]], pa.int64()), "bucket": pa.array(np.full(len(cut) - 1, rows["bucket"][0].as_py()), pa.int32()), "prints": pa.array([b[a:c].tobytes() for a, c in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})


def member(keys: np.ndarray, n: int, back: pa.Table) -> np.ndarray:
    """Which 64-bit keys came back, by range and print."""
    if not len(keys) or not back.num_rows:
        return np.zeros(len(keys), dtype=bool)
    parts = [np.frombuffer(p.as_py(), np.uint32) for p in back["prints"]]
    known = np.sort((np.repeat(back["bucket"].to_numpy(), [len(p) for p in parts]).astype(np.uint64) << np.uint64(32)) | np.concatenate(parts))
    mine = (by_bucket(keys, n) << np.uint64(32)) | (keys & np.uint64(0x7FFFFFFF))
    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
    return known[at] == mine


def candidates(w: Words, n: int, back: pa.Table) -> np.ndarray:
    """Places of windows that may be held by another document."""
    at, a, odd, b = w.anchors()
    hit = member(a, n, back)
    shared = np.zeros(w.n + WIDTH, dtype=bool)
    shared[at[hit]] = True
    every = w.whole(np.arange(w.n), WIDTH)
    good = np.concatenate(([0], np.cumsum(shared)))
    keep = np.zeros(w.n, dtype=bool)
    keep[every] = good[every + LATEST + 1] > good[every]
    keep[odd[member(b, n, back)]] = True
    return np.flatnonzero(keep)


def second_names(w: Words) -> np.ndarray:
    return window_hashes(word_hashes(w.raw, w.starts, w.ends, lane=1), WIDTH, lane=1)


# ---- the three steps


def _finish(ids: np.ndarray, w: Words, gone: np.ndarray, which: np.ndarray) -> dict:
    """Result columns of the documents in `which`; gone flags the removed words."""
    kept = ~gone
    removed = np.concatenate(([0], np.cumsum(gone)))
    spans = []
    digests = []
    raw = w.raw
    # kept words joined by one space: each word with the byte before it, which is made a space
    start, end = w.starts[kept], w.ends[kept]
    length = end - start + 1
    body = np.full(int(length.sum()), 32, np.uint8)
    put = np.cumsum(length) - length
    body[ragged(put + 1, length - 1)] = raw[ragged(start, length - 1)]
    upto = np.concatenate(([0], np.cumsum(np.where(kept, w.ends - w.starts + 1, 0))))
    data = body.tobytes()
    for d in which:
        a, b = int(upto[w.first[d]]), int(upto[w.first[d + 1]])
        digests.append(hashlib.sha256(data[a + 1 : b]).hexdigest())
        lo, hi = int(w.first[d]), int(w.first[d + 1])
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone[lo:hi].astype(np.int8), [0])))) if removed[hi] > removed[lo] else np.empty(0, np.int64)
        spans.append([{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
    return {
        "doc_id": pa.array([None if i == LAST else int(i) for i in ids[which]], pa.int64()),
        "n_words": pa.array(w.first[which + 1] - w.first[which], pa.int64()),
        "n_removed": pa.array(removed[w.first[which + 1]] - removed[w.first[which]], pa.int64()),
        "kept_sha256": pa.array(digests, pa.string()),
        "removed": pa.array(spans, _SPANS),
    }


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<first:long,end:long>>"
_MIDDLE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", _SPANS), ("bucket", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])


def _rows(n: int, **columns) -> pa.Table:
    return pa.table([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _MIDDLE], schema=_MIDDLE)


def _verify(n: int):
    """A chunk and the prints that came back: finished documents (bucket null), window names by range, and the chunk again
    (bucket -1) with the documents that wait."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for blob in left["blob"]:
            ids, raw, offsets = unpack(blob.as_py())
            w = Words(raw, offsets)
            at = candidates(w, n, right)
            wait = np.zeros(len(ids), dtype=bool)
            wait[w.doc[at]] = True
            done = np.flatnonzero(~wait)
            if len(done):
                out.append(_rows(len(done), **_finish(ids, w, np.zeros(w.n, dtype=bool), done)))
            if not len(at):
                continue
            names = np.stack([window_hashes(w.names, WIDTH)[at], second_names(w)[at] >> np.uint64(32)])
            owner = ids[w.doc[at]]
            order = np.lexsort((owner, names[1], names[0]))
            x, y, d = names[0][order], names[1][order], owner[order]
            head = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
            last = np.append(np.flatnonzero(head)[1:], len(x)) - 1
            x, y, low, high = x[head], y[head], d[head], d[last]
            bucket = by_bucket(x, n).astype(np.int64)
            cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
            blobs = [squeezed(x[a:b].tobytes() + y[a:b].astype(np.uint32).tobytes() + low[a:b].astype("<i8").tobytes() + (high[a:b] - low[a:b]).astype("<i8").tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            chunk = key[0].as_py()
            out.append(_rows(len(blobs), bucket=pa.array(bucket[cut[:-1]], pa.int32()), chunk=pa.array(np.full(len(blobs), chunk)), blob=pa.array(blobs, pa.binary())))
            held = np.flatnonzero(wait)
            size = np.diff(offsets)[held]
            waiting = pack(ids[held], raw[ragged(offsets[:-1][held], size)], np.concatenate(([0], np.cumsum(size))))
            out.append(_rows(1, bucket=pa.array([-1], pa.int32()), chunk=pa.array([chunk]), blob=pa.array([waiting], pa.binary())))
        return pa.concat_tables(out) if out else _MIDDLE.empty_table()

    return run


def _smallest(rows: pa.Table) -> pa.Table:
    """Of one range: for each chunk the names of windows that a smaller document holds, with that document."""
    numbers = rows["chunk"].to_pylist()
    x, low, high, y, owner = [], [], [], [], []
    for k, b in enumerate(rows["blob"]):
        raw = unsqueezed(b.as_py())
        m = len(raw) // 28
        x.append(np.frombuffer(raw, np.uint64, m))
        y.append(np.frombuffer(raw, np.uint32, m, 8 * m))
        low.append(np.frombuffer(raw, "<i8", m, 12 * m))
        high.append(low[-1] + np.frombuffer(raw, "<i8", m, 20 * m))
        owner.append(np.full(m, k))
    x, low, high, y, owner = map(np.concatenate, (x, low, high, y, owner))
    order = np.lexsort((y, x))
    x, low, high, y, owner = x[order], low[order], high[order], y[order], owner[order]
    head = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
    least = np.repeat(np.minimum.reduceat(low, head), np.diff(np.append(head, len(x))))
    need = high > least  # else no document of the chunk loses this window
    x, y, owner, least = x[need], y[need], owner[need], least[need]
    order = np.argsort(owner, kind="stable")
    x, y, owner, least = x[order], y[order], owner[order], least[order]
    cut = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)])) if len(owner) else np.zeros(1, np.int64)
    return pa.table({"chunk": pa.array([numbers[owner[a]] for a in cut[:-1]], pa.int64()), "blob": pa.array([squeezed(x[a:b].tobytes() + y[a:b].tobytes() + least[a:b].astype("<i8").tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})


def _remove(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents that waited, and the windows of smaller documents."""
    parts = []
    for b in right["blob"]:
        raw = unsqueezed(b.as_py())
        m = len(raw) // 20
        parts.append((np.frombuffer(raw, np.uint64, m), np.frombuffer(raw, np.uint32, m, 8 * m), np.frombuffer(raw, "<i8", m, 12 * m)))
    x, y, least = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64))
    order = np.lexsort((y, x))
    x, y, least = x[order], y[order], least[order]
    out = []
    for blob in left["blob"]:
        ids, raw, offsets = unpack(blob.as_py())
        w = Words(raw, offsets)
        gone = np.zeros(w.n, dtype=bool)
        at = w.whole(np.arange(w.n), WIDTH)
        if len(x) and len(at):
            mine, check = window_hashes(w.names, WIDTH)[at], (second_names(w)[at] >> np.uint64(32)).astype(np.uint32)
            k = np.searchsorted(x, mine)
            hit = np.zeros(len(at), dtype=bool)
            todo = np.arange(len(at))
            while len(todo):  # equal first names stand side by side
                todo = todo[k[todo] < len(x)]
                todo = todo[x[k[todo]] == mine[todo]]
                hit[todo] |= (y[k[todo]] == check[todo]) & (least[k[todo]] < ids[w.doc[at[todo]]])
                k[todo] += 1
            edge = np.zeros(w.n + 1, np.int32)
            np.add.at(edge, at[hit], 1)
            np.add.at(edge, at[hit] + WIDTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
        out.append(pa.table(_finish(ids, w, gone, np.arange(len(ids)))))
    return pa.concat_tables(out) if out else _MIDDLE.empty_table().select(["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (runs of removed words)."""
    bounded(docs.sparkSession)
    n = buckets(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = rows.mapInArrow(lean(_anchors(n)), "bucket int, chunk long, prints binary")
    back = sent.groupBy("bucket").applyInArrow(_shared, "chunk long, bucket int, prints binary")
    held = rows.mapInArrow(lean(packed), "chunk long, blob binary")
    middle = written(held.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_verify(n), f"{_RESULT}, bucket int, chunk long, blob binary"))
    result = [f.name for f in middle.schema][:5]
    done = middle.where("bucket is null").select(*result)
    least = middle.where("bucket >= 0").select("bucket", "chunk", "blob").groupBy("bucket").applyInArrow(_smallest, "chunk long, blob binary")
    waiting = middle.where("bucket = -1").select("chunk", "blob")
    return done.unionByName(waiting.groupBy("chunk").cogroup(least.groupBy("chunk")).applyInArrow(_remove, _RESULT))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
low AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (s) WHERE least < doc_id),
word AS (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(v, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
