"""Data sources of the sequence formats: spark.read.format("fasta").load(path), with writers and streaming readers.

Files are found and read through pyarrow's file systems, so a path may lie in any store that these know (local, HDFS,
object stores), on any executor. Plain files are cut into byte ranges; a range begins at its first record and reads on
to the end of its last one. Compressed files (.gz) are one partition each.

Options: mode (FAILFAST, or PERMISSIVE: a broken record gives a row with its text in _corrupt_record), splitBytes,
parity (values cut as older readers cut them), zeroValues (SLOW5), table (header, for SAM and SLOW5), ordinals (adds
source_file and ordinal), maxLineSize (longest line).
"""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DataType, MapType, Row, StructType

from .. import schemas
from . import genbank as gb
from . import parsers as P

SPLIT = 64 << 20
#: Bytes that are parsed at once, and records that make a batch.
BLOCK = 8 << 20
BATCH = 4096
LONGEST_LINE = 128 << 20


# ---- files


def file_system(path: str):
    from pyarrow import fs

    if re.match(r"^[a-zA-Z][\w+.-]*://|^file:/", path):
        return fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def files(path: str) -> list[tuple[str, int, int]]:
    """(path, size, time) of a file, a folder or a comma-separated list, in order; hidden files are left out."""
    from pyarrow import fs

    out = []
    for p in path.split(","):
        system, inner = file_system(p.strip())
        head = p.strip()[: len(p.strip()) - len(inner)] if p.strip().endswith(inner) else ""
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(p)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
        out += [(head + f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and not re.search(r"(^|/)[._]", f.path[len(inner.rstrip("/")) + 1 :] if f.path != info.path else f.path.rsplit("/", 1)[-1])]
    return sorted(out)


def open_file(path: str):
    system, inner = file_system(path)
    raw = system.open_input_file(inner)
    return gzip.open(raw) if path.endswith(".gz") else raw


def lines_from(stream, limit: int, encoding: str = "utf-8") -> Iterator[str]:
    for line in io.BufferedReader(_Raw(stream), 1 << 20):
        if len(line) > limit:
            raise P.FormatError(f"line longer than {limit} bytes")
        yield line.decode(encoding, "replace")


class _Raw(io.RawIOBase):
    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.stream.read(len(b))
        b[: len(data)] = data
        return len(data)


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int | None  # None: the whole file
    inside: bool = False  # a record begins at the start


# ---- formats


@dataclass
class Format:
    """How a format is read and written. `begins` tells whether a record begins at a line, given the lines from there."""

    name: str
    ddl: str
    parse: Callable[..., Iterator[dict]]
    text: Callable[..., str] | None = None
    begins: Callable[[list[str]], bool] | None = None
    header: bool = False  # header lines at the top of a file are needed by every range
    header_ddl: str = ""
    vector: str = ""  # name of the functions in `vectors`
    lines: int = 1  # of a record, where blocks are parsed at once


def _fastq_begins(x: list[str]) -> bool:
    return len(x) > 3 and x[0].startswith("@") and x[2].startswith("+") and len(x[1].rstrip()) == len(x[3].rstrip())


FORMATS = {
    "fasta": Format("fasta", schemas.FASTA, lambda it, o: P.fasta(it), lambda r, h: P.fasta_text(r), lambda x: x[0].startswith(">")),
    "fastq": Format("fastq", schemas.FASTQ, lambda it, o: P.fastq(it, o["parity"]), lambda r, h: P.fastq_text(r), _fastq_begins, vector="fastq", lines=4),
    "genbank": Format("genbank", schemas.GENBANK, lambda it, o: gb.genbank(it, o["parity"]), lambda r, h: gb.genbank_text(r), lambda x: x[0].startswith("LOCUS")),
    "sam": Format("sam", schemas.SAM, lambda it, o: P.sam(it, o["parity"]), lambda r, h: P.sam_text(r), lambda x: True, header_ddl=schemas.SAM_HEADER, vector="sam"),
    "pileup": Format("pileup", schemas.PILEUP, lambda it, o: P.pileup(it), lambda r, h: P.pileup_text(r), lambda x: True),
    "slow5": Format("slow5", schemas.SLOW5, lambda it, o: P.slow5(it, o["zeroValues"]), lambda r, h: P.slow5_text(r, h), lambda x: True, header=True, header_ddl=schemas.SLOW5_HEADER),
    "rebase": Format("rebase", schemas.REBASE, lambda it, o: P.rebase(it, o["parity"])),
}


def _flag(options: dict, key: str) -> bool:
    return str(options.get(key, "false")).lower() == "true"


def _plain(v: Any) -> Any:
    return v.asDict(recursive=True) if isinstance(v, Row) else v


def _shaped(value: Any, kind: DataType) -> Any:
    """Dictionaries as tuples in the order of the schema."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return tuple(_shaped(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return [_shaped(v, kind.elementType) for v in value]
    if isinstance(kind, MapType):
        return {k: _shaped(v, kind.valueType) for k, v in value.items()}
    return value


class _Read:
    """What batch and streaming readers share."""

    def __init__(self, form: Format, schema: StructType, options: dict):
        self.form, self.schema, self.path = form, schema, options.get("path", "")
        self.options = {k: _flag(options, k) for k in ("parity", "zeroValues", "ordinals")}
        self.permissive = str(options.get("mode", "FAILFAST")).upper() == "PERMISSIVE"
        self.split = int(options.get("splitBytes", SPLIT))
        self.limit = int(options.get("maxLineSize", LONGEST_LINE))
        self.head = options.get("table") == "header"

    def cut(self, path: str, size: int) -> list[Part]:
        if path.endswith(".gz") or self.form.begins is None or self.head or size <= self.split:
            return [Part(path, 0, None)]
        return [Part(path, at, min(at + self.split, size)) for at in range(0, size, self.split)]

    def lines(self, part: Part) -> Iterator[str]:
        """Lines of the records that begin in the range."""
        with open_file(part.path) as stream:
            if part.end is None:
                yield from lines_from(stream, self.limit)
                return
            if self.form.header and part.start:
                for line in lines_from(stream, self.limit):
                    if not line.startswith(("#", "@")) and "\t" in line and not self._heading(line):
                        break
                    yield line
            stream.seek(max(part.start - 1, 0))
            at, window = part.start, []
            it = lines_from(stream, self.limit)
            if part.start:
                at += len(next(it, "").encode("utf-8", "replace")) - 1
            inside = part.inside
            while True:
                while len(window) < 4 and (line := next(it, None)) is not None:
                    window.append(line)
                if not window:
                    return
                if self.form.begins(window):
                    if at >= part.end:
                        return
                    inside = True
                line = window.pop(0)
                at += len(line.encode("utf-8", "replace"))
                if inside or part.start == 0:
                    yield line

    def _heading(self, line: str) -> bool:
        return not re.match(r"[0-9a-f-]{8,}|[^\t]*\t\d+\t", line)

    def rows(self, part: Part, shaped: Callable[[Any, DataType], Any] = _shaped) -> Iterator[tuple]:
        names = [f.name for f in self.schema.fields]
        count = itertools.count()

        def row(r: dict) -> tuple:
            r = r | {"source_file": part.path, "ordinal": next(count)}
            return tuple(shaped(r.get(f.name), f.dataType) for f in self.schema.fields)

        if self.head:
            with open_file(part.path) as stream:
                it = lines_from(stream, self.limit)
                yield from map(row, [P.sam_header(it, self.options["parity"])] if self.form.name == "sam" else P.slow5_header(it)[0])
            return
        if not self.permissive:
            lines = self.lines(part)
            first = next(lines, None)
            if first is not None or self.form.header:  # a task without rows writes an empty file, and no record need begin in a range
                yield from map(row, self.form.parse(itertools.chain([first], lines) if first is not None else lines, self.options))
            return
        for block in self.blocks(part):
            try:
                yield from [row(r) for r in self.form.parse(iter(block), self.options)]
            except ValueError:
                text = "".join(block)
                if "_corrupt_record" in names:
                    yield row({"_corrupt_record": text})

    def batches(self, part: Part) -> Iterator:
        """Arrow batches of the rows; regular blocks are parsed at once."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)

        def slow(part: Part) -> Iterator:
            it = self.rows(part, lambda value, _: value)  # Arrow takes dictionaries as they are
            while rows := list(itertools.islice(it, BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        if not self.form.vector or self.permissive or self.head or self.options["parity"] or self.options["ordinals"] or part.path.endswith(".gz"):
            yield from slow(part)
            return
        from . import vectors

        parse = getattr(vectors, self.form.vector)
        for at, block in self.whole(part):
            columns = parse(block, self.limit) if block else None
            if columns is None:  # from here on record by record
                yield from slow(Part(part.path, at, 1 << 62 if part.end is None else part.end, True))
                return
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(t.type) for f, t in zip(self.schema.fields, schema, strict=True)], schema=schema)

    def whole(self, part: Part) -> Iterator[tuple[int, bytes]]:
        """(place, bytes) of blocks of whole records that begin in the range; an empty block for what has no regular end."""
        with open_file(part.path) as stream:
            at, step = part.start, self.form.lines
            if part.start:
                at = self.first(part)
                if at is None:
                    return
                stream.seek(at)
            rest = b""
            while part.end is None or at < part.end:
                data = stream.read(BLOCK)
                rest += data
                ends = np.flatnonzero(np.frombuffer(rest, np.uint8) == 10) + 1
                if not data and rest and (not len(ends) or ends[-1] < len(rest)):
                    ends = np.append(ends, len(rest))  # the last line may lack its end
                ends = ends[: len(ends) // step * step][step - 1 :: step]
                if part.end is not None:  # records that begin before the end of the range
                    ends = ends[: 1 + int(np.searchsorted(ends, part.end - at, side="left"))]
                if len(ends):
                    yield at, rest[: ends[-1]]
                    at, rest = at + int(ends[-1]), rest[ends[-1] :]
                    if part.end is not None and at >= part.end:
                        if step > 1 and not self.begins_at(part.path, at):
                            yield at, b""  # what follows is no record and belongs to this range
                        return
                elif data and len(rest) > step * (self.limit + BLOCK):
                    yield at, b""
                    return
                if not data:
                    if rest:
                        yield at, b""
                    return

    def begins_at(self, path: str, at: int) -> bool:
        """Whether a record, or nothing, follows."""
        with open_file(path) as stream:
            stream.seek(at)
            window = list(itertools.islice(lines_from(stream, self.limit), 4))
        return not window or self.form.begins(window)

    def first(self, part: Part) -> int | None:
        """Place of the first record that begins in a range."""
        with open_file(part.path) as stream:
            stream.seek(part.start - 1)
            lines = iter(io.BufferedReader(_Raw(stream), 1 << 16).readline, b"")
            at, window = part.start - 1 + len(next(lines, b"")), []
            while at < part.end:
                while len(window) < 4 and (line := next(lines, None)) is not None:
                    window.append(line)
                if not window:
                    return None
                if self.form.begins([x.decode("utf-8", "replace") for x in window]):
                    return at
                at += len(window.pop(0))
        return None

    def blocks(self, part: Part) -> Iterator[list[str]]:
        """Lines of one record at a time (with the header, where rows need it), for PERMISSIVE."""
        head: list[str] = []
        block: list[str] = []
        step = 4 if self.form.name == "fastq" else 1 if self.form.name in ("sam", "pileup", "slow5") else 0
        for line in self.lines(part):
            if self.form.name == "slow5" and not (head and head[-1].startswith("#read_id")):
                head.append(line)
                continue
            if not line.strip():
                continue
            if block and (len(block) == step if step else self.form.begins is not None and self.form.begins([line])):
                yield head + block
                block = []
            block.append(line)
        if block:
            yield head + block


class _Batch(DataSourceReader):
    def __init__(self, read: _Read):
        self.read_ = read

    def partitions(self) -> list[Part]:
        return [p for path, size, _ in files(self.read_.path) for p in self.read_.cut(path, size)] or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator:
        return self.read_.batches(partition) if partition.path else iter(())


def _mark(path: str, time: int) -> str:
    return hashlib.blake2b(f"{time} {path}".encode(), digest_size=8).hexdigest()


class _Stream(DataSourceStreamReader):
    """Files that were not there before. A batch takes all of them, whatever their time says: the offset holds a mark of 16
    letters for each file that was seen, so that a file with an older time, as copies have, is read as well."""

    def __init__(self, read: _Read):
        self.read_ = read

    def initialOffset(self) -> dict:
        return {"seen": ""}

    def latestOffset(self) -> dict:
        return {"seen": "".join(sorted(_mark(p, t) for p, _, t in files(self.read_.path)))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        old, new = ({x["seen"][k : k + 16] for k in range(0, len(x["seen"]), 16)} for x in (start, end))
        return [p for path, size, t in files(self.read_.path) if _mark(path, t) in new - old for p in self.read_.cut(path, size)]

    def read(self, partition: Part) -> Iterator:
        return self.read_.batches(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _Write(DataSourceArrowWriter):
    """A file for each task. SLOW5 files begin with the header of option `header` (JSON of its read groups), SAM files
    with that of option `header` where it is given."""

    def __init__(self, form: Format, schema: StructType, options: dict, overwrite: bool):
        import json

        self.form, self.path, self.overwrite = form, options["path"], overwrite
        self.header = json.loads(options["header"]) if "header" in options else None
        self.names = schema.fieldNames()
        self.job = uuid.uuid4().hex[:8]
        self.old = []

    def write(self, iterator: Iterator) -> _Written:
        from pyspark import TaskContext

        from . import vectors

        vector = getattr(vectors, f"{self.form.vector}_text") if self.form.vector else lambda batch: None

        system, inner = file_system(self.path)
        system.create_dir(inner, recursive=True)
        context = TaskContext.get()
        name = f"{inner.rstrip('/')}/.part-{context.partitionId():05d}-{self.job}-{context.taskAttemptId()}.{self.form.name}"
        with system.open_output_stream(name) as out:
            reasons = None
            if self.header is not None:
                out.write((P.slow5_header_text(self.header) if self.form.name == "slow5" else P.sam_header_text(self.header)).encode())
                reasons = self.header[0]["end_reason_map"] if self.form.name == "slow5" else None
            for batch in iterator:
                if (texts := vector(batch)) is not None:
                    out.write(vectors.written(texts))
                    continue
                columns = [c.to_pylist(maps_as_pydicts="lossy") for c in batch.columns]
                for row in zip(*columns, strict=True):
                    out.write(self.form.text(dict(zip(self.names, row, strict=True)), reasons).encode())
        return _Written(name)

    def commit(self, messages: list[_Written | None]) -> None:
        """Files get their names when all tasks are done."""
        system, inner = file_system(self.path)
        mine = {m.path for m in messages if m}
        if self.overwrite:
            for path, _, _ in files(self.path):
                p = file_system(path)[1]
                if p not in mine:
                    system.delete_file(p)
        for m in mine:
            folder, _, name = m.rpartition("/")
            system.move(m, f"{folder}/{name[1:]}")

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            if m:
                system.delete_file(m.path)


def _plain_deep(v: Any) -> Any:
    if isinstance(v, Row):
        return {k: _plain_deep(x) for k, x in v.asDict().items()}
    if isinstance(v, (list, tuple)):
        return [_plain_deep(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain_deep(x) for k, x in v.items()}
    return v


def _source(form: Format) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return form.name

        def schema(self) -> str:
            ddl = form.header_ddl if self.options.get("table") == "header" else form.ddl
            ddl += ", source_file string, ordinal bigint" if _flag(self.options, "ordinals") else ""
            return ddl + (", _corrupt_record string" if str(self.options.get("mode", "")).upper() == "PERMISSIVE" else "")

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Batch(_Read(form, schema, dict(self.options)))

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return _Stream(_Read(form, schema, dict(self.options)))

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            if form.text is None:
                raise ValueError(f"{form.name} has no writer")
            return _Write(form, schema, dict(self.options), overwrite)

    Source.__name__ = f"{form.name.capitalize()}Source"
    return Source


def register(spark: SparkSession) -> None:
    """Makes all formats known to the session."""
    for form in FORMATS.values():
        spark.dataSource.register(_source(form))
