"""Chunks of documents: a bounded size of text each, numbered by task, as compressed blobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

from .common import slices, text_bytes

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 4 << 20
#: Stands for a null doc_id.
LAST = np.int64(2**63 - 1)


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueezed(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(ids: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> bytes:
    head = np.array([len(ids)], "<i8").tobytes()
    return squeezed(head + ids.astype("<i8").tobytes() + offsets.astype("<i8").tobytes() + raw.tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, bytes, offsets."""
    data = unsqueezed(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    return np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, np.uint8, offset=16 + 16 * n), np.frombuffer(data, "<i8", n + 1, 8 + 8 * n)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, doc_ids, bytes, offsets. A scan of the same files gives the same numbers again."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, limit=CHUNK):
            raw, offsets = text_bytes(part.column("text"))
            yield number, part.column("doc_id").fill_null(int(LAST)).to_numpy(), raw, offsets
            number += 1


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, ids, raw, offsets in chunks(batches):
        yield pa.RecordBatch.from_pydict({"chunk": [number], "blob": pa.array([pack(ids, raw, offsets)], pa.binary())})
