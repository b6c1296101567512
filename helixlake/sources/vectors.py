"""Records of line formats as Arrow batches: texts of whole batches, and blocks of lines parsed at once.

Only what is regular is handled here. Where a block or a batch holds anything else (nulls, letters beyond ASCII, broken
records), a function returns None, and the parsers and writers of `parsers` take it record by record, with their errors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .parsers import _SAM_INT, _SAM_TEXT

SAM_OPTIONAL = pa.struct([("tag", pa.string()), ("type", pa.string()), ("data", pa.string())])
MAP = pa.map_(pa.string(), pa.string())


def _all(x) -> bool:
    return bool(pc.all(x, min_count=0).as_py())


def _lines(block: bytes) -> pa.Array | None:
    """Lines of a block of whole lines, if it holds nothing but visible ASCII letters, tabs and spaces."""
    raw = np.frombuffer(block, np.uint8)
    if (((raw < 32) & (raw != 9) & (raw != 10)) | (raw > 126)).any():
        return None
    # the text is split as one value
    return pc.split_pattern(pa.array([block.decode("ascii").removesuffix("\n")], pa.large_string()), "\n").flatten().cast(pa.string())


def _lists(x: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of an array of lists without nulls."""
    offsets = x.offsets.to_numpy()
    return offsets - offsets[0], x.flatten()


def _at(x: pa.Array, index: np.ndarray) -> pa.Array:
    return x.take(pa.array(index, pa.int64()))


# ---- reading


def sam(block: bytes, limit: int) -> dict[str, pa.Array] | None:
    lines = _lines(block)
    if lines is None:
        return None
    n = pc.binary_length(lines)
    if len(lines) and pc.max(n).as_py() >= limit:
        return None
    lines = lines.filter(pc.and_(pc.greater(n, 0), pc.invert(pc.starts_with(lines, "@"))))
    if not _all(pc.equal(pc.ascii_trim_whitespace(lines), lines)):
        return None
    offsets, flat = _lists(pc.split_pattern(lines, "\t", max_splits=11))
    width = np.diff(offsets)
    if (width < 11).any():
        return None
    out = {k: _at(flat, offsets[:-1] + i) for k, i in _SAM_TEXT.items()}
    for k, (i, low, high) in _SAM_INT.items():
        column = _at(flat, offsets[:-1] + i)
        if not _all(pc.match_substring_regex(column, "^-?[0-9]{1,18}$")):
            return None
        value = column.cast(pa.int64())
        if len(value) and not (low <= pc.min(value).as_py() and pc.max(value).as_py() <= high):
            return None
        out[k] = value.cast(pa.int16() if k == "mapq" else pa.int32())
    more = width == 12
    inner, optionals = _lists(pc.split_pattern(_at(flat, offsets[:-1][more] + 11), "\t"))
    parts, words = _lists(pc.split_pattern(optionals, ":", max_splits=2))
    if (np.diff(parts) != 3).any():
        return None
    tag, kind, data = (_at(words, np.arange(k, len(words), 3)) for k in range(3))
    if not _all(pc.equal(pc.binary_length(kind), 1)):
        return None
    counts = np.zeros(len(lines), np.int64)
    counts[more] = np.diff(inner)
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    out["optionals"] = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([tag, kind, data], fields=list(SAM_OPTIONAL)))
    return out


def fastq(block: bytes, limit: int) -> dict[str, pa.Array] | None:
    lines = _lines(block)
    if lines is None or len(lines) % 4 or pc.max(pc.binary_length(lines)).as_py() >= limit:
        return None
    head, sequence, plus, quality = (_at(lines, np.arange(k, len(lines), 4)) for k in range(4))
    if not (_all(pc.starts_with(head, "@")) and _all(pc.starts_with(plus, "+")) and _all(pc.match_substring_regex(sequence, "^[ATGCN]+$")) and _all(pc.equal(pc.binary_length(sequence), pc.binary_length(quality)))):
        return None
    offsets, tokens = _lists(pc.split_pattern(pc.utf8_slice_codeunits(head, 1), " "))
    first = np.zeros(len(tokens), bool)
    first[offsets[:-1]] = True
    pairs, words = _lists(pc.split_pattern(tokens.filter(pa.array(~first)), "=", max_splits=1))
    if (np.diff(pairs) != 2).any():
        return None
    keys, values = (_at(words, np.arange(k, len(words), 2)) for k in range(2))
    counts = np.diff(offsets) - 1
    if len(keys):
        row, coded = np.repeat(np.arange(len(counts)), counts), keys.dictionary_encode()
        if len(np.unique(row * len(coded.dictionary) + coded.indices.to_numpy())) < len(keys):
            return None  # of equal keys the last one counts
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return {"identifier": tokens.filter(pa.array(first)), "optionals": pa.MapArray.from_arrays(ends, keys, values), "sequence": sequence, "quality": quality}


# ---- writing


def _text(batch: pa.RecordBatch, *names: str) -> list[pa.Array] | None:
    columns = [batch.column(k) for k in names]
    if any(c.null_count or not (pa.types.is_string(c.type) or pa.types.is_integer(c.type)) for c in columns):
        return None
    return [c.cast(pa.string()) for c in columns]


def _join(mark: str, *x) -> pa.Array:
    return pc.binary_join_element_wise(*x, mark)


def _pieces(counts: np.ndarray, values: pa.Array, mark: str) -> pa.Array:
    """Values of each row, joined, with a mark before each."""
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    joined = pc.binary_join(pa.ListArray.from_arrays(ends, values), mark)
    return pc.if_else(pa.array(counts > 0), _join("", pa.scalar(mark), joined), "")


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)


def sam_text(batch: pa.RecordBatch) -> pa.Array | None:
    fields = _text(batch, "qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
    optionals = batch.column("optionals")
    if fields is None or optionals.type.value_type != SAM_OPTIONAL and [f.name for f in optionals.type.value_type] != ["tag", "type", "data"]:
        return None
    inner = optionals.flatten()
    parts = inner.flatten()
    if inner.null_count or any(p.null_count or not pa.types.is_string(p.type) for p in parts):
        return None
    return _join("", _join("\t", *fields), _pieces(_rows(optionals), _join(":", *parts), "\t"), "\n")


def fastq_text(batch: pa.RecordBatch) -> pa.Array | None:
    fields, optionals = _text(batch, "identifier", "sequence", "quality"), batch.column("optionals")
    if fields is None or optionals.type != MAP and not pa.types.is_map(optionals.type):
        return None
    counts = np.diff(optionals.offsets.to_numpy())
    if optionals.null_count and counts[~np.asarray(optionals.is_valid())].any():
        return None
    low, high = optionals.offsets[0].as_py(), optionals.offsets[-1].as_py()
    keys, values = optionals.keys[low:high] if len(optionals.keys) != high - low else optionals.keys, optionals.items[low:high] if len(optionals.items) != high - low else optionals.items
    if values.null_count or not pa.types.is_string(keys.type) or not pa.types.is_string(values.type):
        return None
    if len(keys):
        coded = keys.dictionary_encode()
        rank = np.argsort(np.argsort(np.array(coded.dictionary.to_pylist(), dtype=object), kind="stable"), kind="stable")
        order = np.lexsort((rank[coded.indices.to_numpy()], np.repeat(np.arange(len(counts)), counts)))
        keys, values = _at(keys, order), _at(values, order)
    identifier, sequence, quality = fields
    return _join("", "@", identifier, _pieces(counts, _join("=", keys, values), " "), "\n", sequence, "\n+\n", quality, "\n")


def written(texts: pa.Array) -> memoryview:
    """The bytes of an array of texts, one after the other."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else [0, 0]
    data = texts.buffers()[2]
    return memoryview(data)[int(ends[0]) : int(ends[-1])] if data is not None else memoryview(b"")
