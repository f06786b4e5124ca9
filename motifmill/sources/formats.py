"""Sequence and pattern files as data sources: spark.read.format("fasta"), "fastq" and "fixed_width".

Files are cut into splits by offset. A split reads the records that begin in it, finding the first by itself, so neither a file
nor a split is ever held whole. Paths may name a file or a folder, on any file system that pyarrow knows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a split, unless the option splitBytes says otherwise.
SPLIT_BYTES = 64 << 20
#: Bytes read at a time, and of a batch that is handed on.
CHUNK = 1 << 20
#: Rows of a written file.
FILE_ROWS = 1 << 18


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"^[a-z0-9]+:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[fs.FileInfo]:
    """The files at a path in the order of their names; those that begin with _ or . are no data."""
    system, base = _opened(path)
    one = system.get_file_info(base)
    if one.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if one.type == fs.FileType.File:
        return [one]
    found = system.get_file_info(fs.FileSelector(base))
    return sorted((f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_."), key=lambda f: f.path)


def _lines(system: fs.FileSystem, path: str, start: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin at or after a place."""
    with system.open_input_file(path) as file:
        at = max(start - 1, 0)
        file.seek(at)
        parts, inside = [], start == 0
        while chunk := file.read(CHUNK):
            first, *others = chunk.split(b"\n")
            parts.append(first)
            for other in others:
                line = b"".join(parts)
                if inside:
                    yield at, line.removesuffix(b"\r")
                at, inside, parts = at + len(line) + 1, True, [other]
        line = b"".join(parts)
        if inside and line:
            yield at, line.removesuffix(b"\r")


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 16 + sum(len(v) for v in row if isinstance(v, str))
        if size > CHUNK:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int
    nth: int = 0
    width: int = 0


class _Reader(DataSourceReader):
    names: list[str] = []

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.size = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Split]:
        return [Split(f.path, at, min(f.size, at + self.size)) for f in _files(self.path) for at in range(0, f.size, self.size)]

    def rows(self, system: fs.FileSystem, split: Split) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, split: Split | None) -> Iterator[pa.RecordBatch]:
        if split is None:  # there are no splits
            return iter(())
        return _batches(self.rows(_opened(self.path)[0], split), self.names, [pa.string()] * len(self.names))


def _word(line: bytes) -> str:
    """The first word of a title, without its sign; empty if a blank follows the sign."""
    return re.split(r"[ \t]", line[1:].decode("utf-8", "replace"), maxsplit=1)[0]


def _record(four: list[tuple[int, bytes]]) -> bool:
    """Whether lines are a FASTQ record: a line of qualities may begin like a title, but no plus comes two lines after it, nor is
    the title after it as long as the plus's line. A file's last line of qualities is missing if it is empty."""
    lines = [line for _, line in four] + [b""] * (4 - len(four))
    return lines[0].startswith(b"@") and lines[2].startswith(b"+") and len(lines[1]) == len(lines[3])


class FastaReader(_Reader):
    names = ["name", "seq"]

    def rows(self, system: fs.FileSystem, split: Split) -> Iterator[tuple]:
        title, body = None, []
        for at, line in _lines(system, split.path, split.start):
            if line.startswith(b">"):
                if title is not None:
                    yield _word(title), b"".join(body).decode("utf-8", "replace")
                title, body = line, []
                if at >= split.end:
                    return
            elif title is not None:
                body.append(line)
            elif at >= split.end:
                return  # all of the split is inside a record
        if title is not None:
            yield _word(title), b"".join(body).decode("utf-8", "replace")


class FastqReader(_Reader):
    names = ["name", "seq", "qual"]

    def rows(self, system: fs.FileSystem, split: Split) -> Iterator[tuple]:
        lines = _lines(system, split.path, split.start)
        ahead = list(islice(lines, 4))
        while len(ahead) > 2 and not _record(ahead):
            ahead = [*ahead[1:], *islice(lines, 1)]
        lines = chain(ahead, lines) if len(ahead) > 2 else iter(())
        while len(four := list(islice(lines, 4))) >= 3 and four[0][0] < split.end:
            (_, title), (_, seq), (_, plus), (_, qual) = four if len(four) == 4 else [*four, (0, b"")]
            if not title.startswith(b"@") or not plus.startswith(b"+"):
                raise ValueError(f"{split.path}: no record of four lines at {four[0][0]}")
            yield _word(title), seq.decode("utf-8", "replace"), qual.decode("utf-8", "replace")


class FixedWidthReader(_Reader):
    """(nth, pattern): rows of a fixed number of bytes after a first line '# number=N length=L', numbered over all files."""

    def partitions(self) -> list[Split]:
        system, splits, nth = _opened(self.path)[0], [], 0
        for f in _files(self.path):
            head = next(_lines(system, f.path, 0), (0, b""))[1]
            number, width = (re.search(rb"\b" + k + rb"=(\d+)", head) for k in (b"number", b"length"))
            if not number or not width or not int(width[1]):
                raise ValueError(f"{f.path}: no line '# number=N length=L' at the beginning")
            n, w, start = int(number[1]), int(width[1]), len(head) + 1
            if f.size < start + n * w:
                raise ValueError(f"{f.path}: fewer rows than its first line says")
            each = max(1, self.size // w)
            splits += [Split(f.path, start + k * w, start + min(n, k + each) * w, nth + k, w) for k in range(0, n, each)]
            nth += n
        return splits

    def read(self, split: Split | None) -> Iterator[pa.RecordBatch]:
        if split is None:
            return
        each = max(1, CHUNK // split.width)
        with _opened(self.path)[0].open_input_file(split.path) as file:
            file.seek(split.start)
            n = (split.end - split.start) // split.width
            for k in range(0, n, each):
                some = file.read(min(each, n - k) * split.width).decode("latin-1")
                rows = [some[p : p + split.width] for p in range(0, len(some), split.width)]
                yield pa.RecordBatch.from_arrays([pa.array(range(split.nth + k, split.nth + k + len(rows)), pa.int64()), pa.array(rows, pa.string())], ["nth", "pattern"])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class FixedWidthWriter(DataSourceWriter):
    """Files of rows of a fixed width, named in the order of the partitions. They are seen once the whole write is done: tasks
    write hidden files, which the commit renames and an abort removes."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.width = options["path"], int(options["length"])
        if overwrite:
            raise ValueError("this source only appends; write to a new folder")
        system, base = _opened(self.path)
        system.create_dir(base, recursive=True)

    def write(self, rows: Iterator[Row]) -> Written:
        system, base = _opened(self.path)
        part, done = TaskContext.get().partitionId(), []
        for first in rows:
            data = bytearray()  # the rows' bytes alone, as the first line tells their number
            for row in chain([first], islice(rows, FILE_ROWS - 1)):
                text = row[0].encode("latin-1")
                if len(text) != self.width:
                    raise ValueError(f"a row is not of {self.width} bytes")
                data += text
            name = f"part-{part:06d}-{len(done):06d}-{uuid.uuid4().hex}"
            with system.open_output_stream(f"{base}/_{name}") as out:
                out.write(f"# number={len(data) // self.width} length={self.width}\n".encode())
                out.write(data)
            done.append(name)
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _opened(self.path)
        for name in chain.from_iterable(m.files for m in messages if m):
            system.move(f"{base}/_{name}", f"{base}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, base = _opened(self.path)
        for name in chain.from_iterable(m.files for m in messages if m):
            system.delete_file(f"{base}/_{name}")


class Fasta(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "name string, seq string"

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


class Fastq(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "name string, seq string, qual string"

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


class FixedWidth(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixed_width"

    def schema(self) -> str:
        return "nth long, pattern string"

    def reader(self, schema) -> FixedWidthReader:
        return FixedWidthReader(self.options)

    def writer(self, schema, overwrite: bool) -> FixedWidthWriter:
        return FixedWidthWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    for source in (Fasta, Fastq, FixedWidth):
        spark.dataSource.register(source)
