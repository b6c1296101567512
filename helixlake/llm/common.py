"""What several operators share: word hashes over Arrow text columns, blob shuffles, the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule [^\x20\x09-\x0D]+ as a class for Java regular expressions.
WS = r"[\x20\x09-\x0D]"
#: Text bytes that one vectorised step holds at once.
SLICE_BYTES = 4 << 20

_WS_BYTES = np.zeros(256, dtype=bool)
_WS_BYTES[[0x20, *range(0x09, 0x0E)]] = True


#: Bytes of rows that go to a Python worker at once, unless the session says otherwise.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, where the session leaves that open: 10,000 long texts are no bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary folder in
    local mode and an error on a cluster, whose executors would write to their own disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="helixlake-")
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone by now
        pass


#: Drops the shuffle files of a query when it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df.written_to)


def buckets(spark: SparkSession, per_partition: int = 4) -> int:
    """Ranges of a blob shuffle; follows spark.sql.shuffle.partitions, which is set by the size of the input."""
    return max(8, per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    if len(size):  # parts of like sizes, none of a few bytes
        limit = -(-int(total[-1]) // max(1, round(int(total[-1]) / limit))) + int(size.mean())
    at = 0
    while at < len(size):
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right"))
        end = max(end, at + 1)
        yield batch.slice(at, end - at)
        at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the n+1 offsets; a null text is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.empty(0, np.uint8)
    return raw, at - at[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_space: np.ndarray = _WS_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word (n+1 values)."""
    n = len(raw)
    if n == 0:
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    solid = ~is_space[raw]
    edge = np.zeros(n + 1, dtype=bool)  # before this byte a document begins
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finalizer of SplitMix64, a bijection of 64-bit values."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}
_STEP = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_BYTE_CODES = [mix(np.arange(256, dtype=np.uint64), 11 + lane) for lane in range(2)]


def _powers(n: int, lane: int) -> tuple[np.ndarray, np.uint64]:
    """Powers 0 to m - 1 of the lane's step, m > n, and the inverse of power m - 1: backwards they are negative powers."""
    have = _POWERS.get(lane)
    if have is None or len(have) < n + 1:
        size = 1 << max(16, n.bit_length())
        have = np.full(size, _STEP[lane], dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _POWERS[lane] = have
    return have, np.uint64(pow(int(have[-1]), -1, 1 << 64))


def released() -> None:
    """Gives memory that is free but held back to the system: workers live on after a task."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """A function of batches that leaves no memory behind in its worker."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return task


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable):
    """What a worker keeps from task to task: one object, the last one that was asked for."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: sums of byte codes times powers, shifted to the word's start, then mixed."""
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    codes = _BYTE_CODES[lane].copy()
    if lower:
        codes[65:91] = codes[97:123]
    up, back = _powers(len(raw), lane)
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(codes[raw] * up[: len(raw)], out=total[1:])
    length = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * (up[len(up) - 1 - starts] * back) + length, lane)


def window_hashes(words: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """Hash of each window of `width` following words, across document ends as well: the caller drops those."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    step = np.uint64(_STEP[lane])
    for j in range(1, width):
        out *= step
        out += words[j : j + n]
    return mix(out, 31 + lane)


def segments(offsets: np.ndarray) -> np.ndarray:
    """For each element the index of the segment that holds it."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def by_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket 0 to n-1 of 64-bit hashes, from their high half."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each range, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first - starts, lengths)


def small(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that must have at most `limit` rows, collected; raises beyond that."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows


def words_of(text: str | F.Column) -> F.Column:
    """Native: the array of words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), WS + "+"), lambda w: w != "")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: F.Column | None, limit: int) -> DataFrame:
    """doc_id, text, label of at most `limit` labelled rows, the first by a hash of doc_id; the bound makes the broadcast safe."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.where(train) if train is not None else rows
    chosen = rows.select("doc_id", F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")


def fold(modulus: int) -> F.Column:
    """crc32 of doc_id as text, mod `modulus`; a null id is like an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
