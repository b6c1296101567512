"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct five-word shingles. Two sets of sizes n and m can reach similarity t
only if each shares t times its size with the other, so:

1. Tasks send short prints of the shingles of their chunk, with counts, to ranges; ranges add them up and send back those
   that are counted twice or more. A document of which less than t of its shingles came back has no partner and is done
   with. Equal sets become one class each.
2. All sets are ordered by document frequency, rarest first. With a = n - ceil(t n), two similar sets share l shingles at
   least among their first a + l, for every l. Each class takes the l with the least estimated cost: postings to read,
   and the candidates that are left (by Markov's inequality at most the postings over l), each with its price. A pair
   has to share the smaller l of the two, each at a rank that leaves room for the overlap.
3. Lists of up to CROWD classes give all their pairs, which are counted against l and verified exactly. A longer list
   goes by a pivot p, the set with the most frequent shingles: all others are held against p alone. Two sets that are both
   similar to p are in one component. Else, x being the one that is not, x and a partner y have to share
   ceil(t / (1 + t) (|x| + |y|)) shingles, of which x shares |x & p| at most inside p: the rest, which is known but for |y|,
   and |y| is no less than the least size in the list, lies outside p. So the classes of a list are dealt anew by the
   rarest of their shingles outside p, as many as the overlap leaves open; the few that can have a partner y small enough
   to share nothing outside p form a list of their own. These lists are treated alike, level by level, until they have no
   more pairs than there are classes. Near misses, whose own shingles nobody shares, drop out there without being held
   against each other. `linked` takes all pairs of classes of all lists, and gives each row its number of links.
4. Components by label propagation with pointer jumping.

No step collects a posting list or a group: a task sends a shingle once, classes meet pivots in a join that Spark can
split, and a group of near copies is linked by its pivots, in proportion to its postings.

Defined results: a null or empty text, or one of white space, has an empty set, links with nothing and is a component of
its own; a null doc_id is linked with nothing and has a null component; repeated rows with the same id are in one
component if their texts link; a text of any length is read whole; an empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import LAST, chunks, packed, unpack
from .common import bounded, buckets, by_bucket, forget, lean, mix, released, segments, table, window_hashes, word_hashes, word_spans, written

WIDTH = 5
#: The similarity as a fraction.
NUM, DEN = 3, 4
#: Price of verifying a candidate, in postings read.
PRICE = 4.0
#: Open classes of a list that are all held against the whole list; a list with more goes by its pivot.
CROWD = 16
#: Levels of pivots; what is crowded after them is held against each other.
LEVELS = 8
_LOW = np.uint64(0x7FFFFFFF)


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, sorted inside each, and the n+1 offsets."""
    starts, ends, first = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends, lower=True)
    doc = segments(first)
    n = np.diff(first)
    whole = window_hashes(words, width)
    inside = doc[: len(whole)] == doc[width - 1 :] if len(whole) else np.zeros(0, dtype=bool)
    keys, owner = [whole[inside]], [doc[: len(whole)][inside]]
    for k in range(1, width):
        at = first[:-1][n == k]
        if len(at):
            keys.append(mix(window_hashes(words, k)[at], 90 + k))
            owner.append(doc[at])
    key, own = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    if len(key):
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])))
        key, own = key[new], own[new]
    return key, np.searchsorted(own, np.arange(len(n) + 1))


def class_names(key: np.ndarray, at: np.ndarray) -> list[bytes]:
    """16 bytes for each set; equal sets have equal names."""
    return [hashlib.blake2b(key[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Shingles, offsets, class names, and for each document the first one of its class in the chunk."""
    key, at = shingles(raw, offsets)
    names = class_names(key, at)
    seen: dict[bytes, int] = {}
    return key, at, names, np.array([seen.setdefault(c, k) for k, c in enumerate(names)], dtype=np.int64)


def _send(n: int):
    """Prints of distinct shingles by range: those of one class of the chunk, then those of several with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, raw, offsets in chunks(batches):
            key, at, _, leader = _sets(raw, offsets)
            lead = leader == np.arange(len(leader))
            k = np.sort(key[np.repeat(lead, np.diff(at))])
            if not len(k):
                continue
            head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            count = np.minimum(np.diff(np.append(head, len(k))), 65535).astype(np.uint16)
            k = k[head]
            bucket = by_bucket(k, n).astype(np.int64)
            prints = (k & _LOW).astype(np.uint32)
            cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
            single, many, counts = [], [], []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                one = count[a:b] == 1
                single.append(prints[a:b][one].tobytes())
                many.append(prints[a:b][~one].tobytes())
                counts.append(count[a:b][~one].tobytes())
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[cut[:-1]], pa.int32()), "chunk": pa.array(np.full(len(cut) - 1, number)), "single": pa.array(single, pa.binary()), "many": pa.array(many, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return run


def _frequent(rows: pa.Table) -> pa.Table:
    """Of one range: for each chunk its prints with a sum of two or more, and the sums."""
    numbers = rows["chunk"].to_pylist()
    single = [np.frombuffer(b.as_py(), np.uint32) for b in rows["single"]]
    many = [np.frombuffer(b.as_py(), np.uint32) for b in rows["many"]]
    counts = [np.frombuffer(b.as_py(), np.uint16) for b in rows["counts"]]
    prints = np.concatenate(single + many)
    count = np.concatenate([np.ones(sum(map(len, single)), np.int64), *(c.astype(np.int64) for c in counts)])
    owner = np.concatenate([np.repeat(np.arange(len(single)), [len(p) for p in single]), np.repeat(np.arange(len(many)), [len(p) for p in many])])
    order = np.argsort(prints, kind="stable")
    p, c, o = prints[order], count[order], owner[order]
    head = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
    total = np.repeat(np.add.reduceat(c, head), np.diff(np.append(head, len(p))))
    good = total > 1
    p, o, total = p[good], o[good], np.minimum(total[good], 2**32 - 1).astype(np.uint32)
    order = np.argsort(o, kind="stable")
    p, o, total = p[order], o[order], total[order]
    cut = np.concatenate(([0], np.flatnonzero(np.diff(o)) + 1, [len(o)])) if len(o) else np.zeros(1, np.int64)
    pairs = list(zip(cut[:-1], cut[1:], strict=True))
    return pa.table({"chunk": pa.array([numbers[o[a]] for a, _ in pairs], pa.int64()), "bucket": pa.array(np.full(len(pairs), rows["bucket"][0].as_py()), pa.int32()), "prints": pa.array([p[a:b].tobytes() for a, b in pairs], pa.binary()), "sums": pa.array([total[a:b].tobytes() for a, b in pairs], pa.binary())})


_DOCS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("name", pa.binary()), ("shared", pa.binary()), ("sums", pa.binary())])


def _alive(n: int):
    """Documents of a chunk: doc_id, n; name, shared shingles (rarest first) and their sums where a partner is possible."""

    def run(key_, left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows:
            parts = [np.frombuffer(p.as_py(), np.uint32) for p in right["prints"]]
            known = (np.repeat(right["bucket"].to_numpy(), [len(p) for p in parts]).astype(np.uint64) << np.uint64(32)) | np.concatenate(parts)
            sums = np.concatenate([np.frombuffer(p.as_py(), np.uint32) for p in right["sums"]])
            order = np.argsort(known)
            known, sums = known[order], sums[order]
        else:
            known, sums = np.empty(0, np.uint64), np.empty(0, np.uint32)
        out = []
        for blob in left["blob"]:
            ids, raw, offsets = unpack(blob.as_py())
            key, at, names, leader = _sets(raw, offsets)
            size = np.diff(at)
            if len(known) and len(key):
                mine = (by_bucket(key, n) << np.uint64(32)) | (key & _LOW)
                k = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                back = np.where(known[k] == mine, sums[k], 0)
            else:
                back = np.zeros(len(key), np.uint32)
            seen = np.concatenate(([0], np.cumsum(back > 0)))
            shared = seen[at[1:]] - seen[at[:-1]]
            copies = np.bincount(leader, minlength=len(ids))[leader]
            alive = (size > 0) & (ids != LAST) & ((DEN * shared >= NUM * size) | (copies > 1))
            name, held, freq = [None] * len(ids), [None] * len(ids), [None] * len(ids)
            for d in np.flatnonzero(alive):
                a, b = at[d], at[d + 1]
                name[d] = names[d]
                f = back[a:b]
                k = np.flatnonzero(f)
                k = k[np.lexsort((key[a:b][k], f[k]))]
                held[d], freq[d] = key[a:b][k].tobytes(), f[k].tobytes()
            out.append(pa.table([pa.array([None if i == LAST else int(i) for i in ids], pa.int64()), pa.array(size, pa.int64()), pa.array(name, pa.binary()), pa.array(held, pa.binary()), pa.array(freq, pa.binary())], schema=_DOCS))
        released()
        return pa.concat_tables(out) if out else _DOCS.empty_table()

    return run


def prefix(freq: np.ndarray, n: int) -> tuple[int, int]:
    """(l, shared shingles to post) of a class with n shingles, of which these, rarest first, are shared.

    Posted are the first a + l places, those of unshared shingles left out. The cost looks at the places that a partner of
    the same size leaves: a match behind them is dropped by its rank when the posting is read.
    """
    a, near = n - -(-NUM * n // DEN), n - -(-2 * NUM * n // (NUM + DEN))
    unshared = n - len(freq)
    if a < unshared:
        return 0, 0
    total = np.concatenate(([0.0], np.cumsum(freq.astype(np.float64))))
    lengths = np.arange(1, n - a + 1)
    read = total[np.clip(near - unshared + lengths, 0, len(freq))]
    best = int(np.argmin(read * (1 + PRICE / lengths) + 1e-9 * lengths)) + 1
    return best, a - unshared + best


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, names, sizes, least, ranks, central = [], [], [], [], [], []

        def flush() -> pa.RecordBatch:
            k = [len(t) for t in tokens]
            return pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate(tokens).view(np.int64)), "name": pa.array(names, pa.binary()).take(pa.array(np.repeat(np.arange(len(k)), k))), "n": pa.array(np.repeat(sizes, k), pa.int64()), "l": pa.array(np.repeat(least, k), pa.int32()), "r": pa.array(np.concatenate(ranks), pa.int64()), "score": pa.array(np.repeat(central, k), pa.float64())})

        held = 0
        for name, n, shared, freq in zip(batch.column("name").to_pylist(), batch.column("n").to_pylist(), batch.column("shared"), batch.column("sums"), strict=True):
            often = np.frombuffer(freq.as_py(), np.uint32)
            count, post = prefix(often, n)
            if post:
                central.append(float(often.sum(dtype=np.float64)) / n)
                tokens.append(np.frombuffer(shared.as_py(), np.uint64, post))
                names.append(name)
                sizes.append(n)
                least.append(count)
                ranks.append(np.arange(post) + n - len(shared.as_py()) // 8)
                held += post
                if held > 200_000:
                    yield flush()
                    tokens, names, sizes, least, ranks, central, held = [], [], [], [], [], [], 0
        if tokens:
            yield flush()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for n, m, x, y in zip(batch.column("n").to_pylist(), batch.column("m").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
            both = np.concatenate([np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)])
            both.sort()
            i = int((both[1:] == both[:-1]).sum())
            good.append(DEN * i >= NUM * (n + m - i))
        kept = batch.filter(pa.array(good, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose sets are similar; exact."""
    left = classes.select(F.col("name").alias("a"), "n", F.col("shared").alias("x"))
    right = classes.select(F.col("name").alias("b"), F.col("n").alias("m"), F.col("shared").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(lean(_verify), "a binary, b binary")


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """name, label of all linked names: the smallest name that links reach. Begins with the labels of `start`; takes the
    least labels of neighbours, then the label's label, until nothing changes."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    known = both.groupBy(F.col("a").alias("name")).agg(F.least(F.first("a"), F.min("b")).alias("label"))
    if start is not None:
        known = known.join(start.withColumnRenamed("label", "had"), "name", "full").select("name", F.least("label", "had").alias("label"))
    new = written(known)
    while True:
        known = new.select("name", "label")
        near = both.join(known.withColumnRenamed("name", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = known.join(near, known.name == near.a, "left").select("name", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jump = step.join(known.select(F.col("name").alias("to"), F.col("label").alias("up")), "to", "left")
        old, new = new, written(jump.select("name", "old", F.least("to", F.coalesce("up", "to")).alias("label")))
        forget(old)
        if new.where(F.col("old") != F.col("label")).isEmpty():
            forget(both)
            return new


def close_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes, a < b, that share enough postings to be similar."""
    x, y = (lists.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("name", "n", "l", "r"))) for s in "xy")
    # at the k-th common shingle, k <= l, both have to hold the rest of the overlap from its rank on
    rest_of = F.least(F.col("n_x") - F.col("r_x"), F.col("n_y") - F.col("r_y")) + F.least("l_x", "l_y") - 1
    close = (F.col("name_x") < F.col("name_y")) & ((NUM + DEN) * rest_of >= NUM * (F.col("n_x") + F.col("n_y")))
    return x.join(y, "token").where(close).groupBy(F.col("name_x").alias("a"), F.col("name_y").alias("b")).agg(F.count("*").alias("c"), F.min(F.least("l_x", "l_y")).alias("l")).where("c >= l").select("a", "b")


def open_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of lists (chain, token); a is open, and the smaller one if both are."""
    x = lists.where("open").select("chain", "token", F.col("name").alias("a"))
    y = lists.select("chain", "token", F.col("name").alias("b"), "open")
    return x.join(y, ["chain", "token"]).where((F.col("a") < F.col("b")) | (~F.col("open") & (F.col("a") != F.col("b")))).select("a", "b").distinct()


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes and a pivot of their lists: whether they are similar; the largest partner that shares nothing outside the
    pivot; and the shingles outside the pivot that lead to the others, if no class of the lists has less than `low`."""
    for batch in batches:
        linked, within, tokens = [], [], []
        for low, n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("low", "n", "m")), batch.column("x"), batch.column("y"), strict=True):
            mine = np.frombuffer(x.as_py(), np.uint64)
            common = np.isin(mine, np.frombuffer(y.as_py(), np.uint64))
            i = int(common.sum())
            own = -(-NUM * n // DEN)
            least = max(1, -(-NUM * (n + max(low, own)) // (NUM + DEN)) - i)
            post = min(n - i - least, n - own) + 1 - (n - len(mine))
            linked.append(DEN * i >= NUM * (n + m - i))
            within.append((NUM + DEN) * i // NUM - n)
            tokens.append(mine[~common][: max(post, 0)].view(np.int64))
        at = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(tokens) if tokens else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("chain", "a", "b", "low", "n", "score")), pa.array(linked, pa.bool_()), pa.array(within, pa.int64()), lists], names=["chain", "a", "b", "low", "n", "score", "linked", "within", "tokens"])


def against(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (chain, a, b, low, score), b a pivot; n, linked, within and tokens of a."""
    left = classes.select(F.col("name").alias("a"), "n", F.col("shared").alias("x"))
    right = classes.select(F.col("name").alias("b"), F.col("n").alias("m"), F.col("shared").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("chain", "a", "b", "low", "n", "score", "m", "x", "y").mapInArrow(lean(_against), "chain long, a binary, b binary, low long, n long, score double, linked boolean, within long, tokens array<long>")


def inner_lists(seen: DataFrame) -> DataFrame:
    """Lists of the classes that may be similar without sharing a shingle outside their pivot: of sizes within the largest
    partner of another one that is not similar to the pivot."""
    reach = seen.where(~F.col("linked") & (F.col("within") >= F.col("low"))).groupBy("chain", "b").agg(F.max("within").alias("most"), F.min("n").alias("smallest"))
    open_ = ~F.col("linked") & (F.col("within") >= F.col("low"))
    return seen.join(reach, ["chain", "b"]).where(open_ | ((F.col("n") <= F.col("most")) & (F.col("within") >= F.col("smallest")))).select(F.xxhash64("chain", "b").alias("chain"), F.lit(0).cast("long").alias("token"), F.col("a").alias("name"), "n", "score", open_.alias("open"))


def postings_of(classes: DataFrame) -> DataFrame:
    return written(classes.where("shared is not null").mapInArrow(lean(_postings), "token long, name binary, n long, l int, r long, score double"))


def crowds(lists: DataFrame, *key: str) -> DataFrame:
    """Lists of two classes or more, one of them open, with the number of open ones, least size and pivot: the class whose
    shingles are the most frequent ones."""
    heads = lists.groupBy(*key).agg(F.count("*").alias("held"), F.count_if("open").alias("opened"), F.min("n").alias("low"), F.max(F.struct("score", "name")).alias("head")).where("held > 1 and opened > 0")
    return written(lists.join(heads.select(*key, "opened", "low", F.col("head.name").alias("pivot")), [*key]))


def links_of(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Links (a, b) between classes, enough of them for the components of all links; and labels to begin with."""
    postings = postings_of(classes)
    lists = crowds(postings.select("*", F.lit(0).cast("long").alias("chain"), F.lit(True).alias("open")), "token")
    forget(postings)
    nodes, near, found = classes.count(), [], []
    for level in range(LEVELS + 1):
        crowded = F.col("opened") > CROWD
        # no more pairs than classes: no pivots any more
        if level == LEVELS or (lists.where(crowded).agg(F.sum("opened")).first()[0] or 0) <= nodes:
            crowded = F.lit(False)
        near.append(written((open_pairs if level else close_pairs)(lists.where(~crowded))))
        pairs = written(lists.where(crowded & (F.col("name") != F.col("pivot"))).groupBy("chain", F.col("name").alias("a"), F.col("pivot").alias("b")).agg(F.min("low").alias("low"), F.first("score").alias("score")))
        forget(lists)
        if pairs.isEmpty():
            forget(pairs)
            break
        seen = written(against(pairs, classes))
        forget(pairs)
        found.append(written(seen.where("linked").select("a", "b").distinct()))
        outer = seen.select(F.xxhash64("chain", "b").alias("chain"), F.explode("tokens").alias("token"), F.col("a").alias("name"), "n", "score", (~F.col("linked")).alias("open"))
        lists = crowds(outer.unionByName(inner_lists(seen)), "chain", "token")
        forget(seen)
    labels = components(reduce(DataFrame.unionByName, found)).select("name", "label") if found else None
    pairs = reduce(DataFrame.unionByName, near).distinct()
    if labels is not None:
        of = lambda side: labels.select(F.col("name").alias(side), F.col("label").alias(f"label_{side}"))
        pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")
    last = written(verified(pairs, classes))
    forget(*near)
    return reduce(DataFrame.unionByName, found, last), labels


def _read(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n; name where a partner is possible), and their classes."""
    bounded(docs.sparkSession)
    n = buckets(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    back = rows.mapInArrow(lean(_send(n)), "bucket int, chunk long, single binary, many binary, counts binary").groupBy("bucket").applyInArrow(_frequent, "chunk long, bucket int, prints binary, sums binary")
    held = rows.mapInArrow(lean(packed), "chunk long, blob binary")
    found = written(held.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_alive(n), "doc_id long, n long, name binary, shared binary, sums binary"))
    alive = found.where("name is not null")
    classes = written(alive.groupBy("name").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("shared").alias("shared"), F.first("sums").alias("sums")))
    return found, classes


def _known(classes: DataFrame, linked: DataFrame) -> DataFrame:
    """name, component_id of all classes, from the labels of the linked ones."""
    labels = written(classes.select("name").join(linked, "name", "left").select("name", F.coalesce("label", "name").alias("label")))
    low = classes.select("name", "rep").join(labels, "name").groupBy("label").agg(F.min("rep").alias("component_id"))
    return labels.join(low, "label").select("name", "component_id")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    found, classes = _read(docs)
    known = _known(classes, components(*links_of(classes)))
    single = found.where("name is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return single.unionByName(found.where("name is not null").select("doc_id", "n", "name").join(known, "name").select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: the other rows with ids whose sets are similar, equal ones included.

    All pairs of similar classes are found, without pivots: a group of many differing near copies takes the square of its
    classes. Rows with null ids have and are no links.
    """
    found, classes = _read(docs)
    links = written(verified(close_pairs(postings_of(classes)), classes))
    known = _known(classes, components(links))
    size = written(found.where("name is not null").groupBy("name").agg(F.count("*").alias("rows")))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(size.withColumnRenamed("name", "b"), "b").groupBy(F.col("a").alias("name")).agg(F.sum("rows").alias("near"))
    counts = size.join(near, "name", "left").select("name", (F.col("rows") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    single = found.where("name is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    several = found.where("name is not null").select("doc_id", F.col("n").alias("n_shingles"), "name").join(known, "name").join(counts, "name")
    return single.unionByName(several.select("doc_id", "n_shingles", "component_id", "n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that with the smallest id (of equal ids, by a hash of the text); all columns.
    Rows without id or words stay. Each row is joined by a key of its own, so that equal ids do not stand for each other."""
    rows = written(docs.withColumn("__key", F.monotonically_increasing_id()))
    named = rows.where("doc_id is not null")
    parts = written(joined(named.select(F.col("__key").alias("doc_id"), "text")).select(F.col("doc_id").alias("__key"), "component_id"))
    order = F.struct("doc_id", F.xxhash64("text").alias("tie"), "__key")
    first = named.select("__key", order.alias("order")).join(parts, "__key").groupBy("component_id").agg(F.min("order").alias("least")).select(F.col("least.__key").alias("__key"))
    gone = parts.select("__key").join(first, "__key", "left_anti")
    return rows.join(gone, "__key", "left_anti").select(*docs.columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x) USING (doc_id)
"""
