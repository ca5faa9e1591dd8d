"""The pair formats as a data source of their own: spark.read, readStream and write with format("seqpairs").

Files are reached through pyarrow's file systems (local paths, and URIs that it knows, such as hdfs:// and s3://); for other
stores there is sources.pairs.read_pairs, which uses Spark's own readers. Large .seq files are read in parts: a part begins
with the first line that starts with '>'. In the other formats only a file's beginning tells which lines go together, so
a file is one part.

Options: path (also load()'s); kind (seq, txt or fasta, in place of the files' extensions); mode (PERMISSIVE: a last line or
record without a partner is dropped; FAILFAST: it is an error); splitBytes. Others are refused, as are unknown extensions.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from seqloom.sources.pairs import FORMATS

SCHEMA = "file string, at bigint, a string, b string"
OPTIONS = {"path", "kind", "mode", "splitbytes"}
SPLIT_BYTES, ROWS, BLOCK = 64 << 20, 4096, 1 << 20


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    """Bytes of a file, from first up to last; pairs that begin there are the part's."""

    file: str
    kind: str
    first: int
    last: int

    def __init__(self, file: str, kind: str, first: int, last: int):
        self.file, self.kind, self.first, self.last = file, kind, first, last


class _Files:
    """What reading batches and streams have in common."""

    def __init__(self, options: dict[str, str]):
        given = {k.lower(): v for k, v in options.items()}
        if unknown := given.keys() - OPTIONS:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        if "path" not in given:
            raise ValueError("a path is needed")
        self.path, self.kind, self.mode = given["path"], given.get("kind"), given.get("mode", "PERMISSIVE").upper()
        self.split = int(given.get("splitbytes", SPLIT_BYTES))
        if self.mode not in ("PERMISSIVE", "FAILFAST") or self.split < 1:
            raise ValueError("mode is PERMISSIVE or FAILFAST, and splitBytes at least 1")

    def files(self) -> list[fs.FileInfo]:
        system, path = _file_system(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
        return [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]

    def parts(self, files: list[fs.FileInfo]) -> list[Part]:
        out = []
        for f in sorted(files, key=lambda f: f.path):
            extension = self.kind or f.extension.lower()
            if extension not in FORMATS:
                raise ValueError(f"unknown extension {extension!r}; known are {', '.join(FORMATS)}")
            kind = FORMATS[extension]
            step = self.split if kind == "seq" else max(1, f.size)
            out += [Part(f.path, kind, s, min(s + step, f.size)) for s in range(0, f.size, step)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(self.path)
        with system.open_input_file(part.file) as f:
            rows: list[tuple[str, int, str, str]] = []
            for at, a, b in self._pairs(f, part):
                rows.append((part.file, at, a, b))
                if len(rows) == ROWS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _pairs(self, f: pa.NativeFile, part: Part) -> Iterator[tuple[int, str, str]]:
        held: tuple[int, str] | None = None
        units = _records(f) if part.kind == "fasta" else _lines(f, max(0, part.first - 1), skip=part.first > 0)
        for at, text in units:
            if part.kind == "seq":
                if held is None and (at >= part.last or part.first and text.startswith("<")):
                    if at >= part.last:
                        return
                    continue  # the second line of a pair that begins in the part before
                if text[:1] != ("<" if held else ">"):
                    raise ValueError(f"a .seq line must start with > and < in turn: {text[:40]}")
                text = text[1:]
            if held is None:
                held = at, text
            else:
                yield held[0], held[1], text
                held = None
        if held and self.mode == "FAILFAST":
            raise ValueError(f"the last line of {part.file} has no partner")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "at": pa.int64(), "a": pa.string(), "b": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))


def _lines(f: pa.NativeFile, first: int, skip: bool) -> Iterator[tuple[int, str]]:
    """Lines from a byte on, each with its own place; skip: without what is left of the line that holds that byte."""
    f.seek(first)
    rest, at = b"", first
    while True:
        block = f.read(BLOCK)
        lines = (rest + block).split(b"\n")
        rest = lines.pop() if block else b""
        for line in lines:
            if not block and not line:
                break
            if not skip:
                yield at, line.removesuffix(b"\r").decode()
            skip = False
            at += len(line) + 1
        if not block:
            return


def _records(f: pa.NativeFile) -> Iterator[tuple[int, str]]:
    """Sequences of FASTA records, white space left out, each with its record's place."""
    begun, own = None, []
    for at, line in _lines(f, 0, skip=False):
        if line.startswith(">"):
            if begun is not None:
                yield begun, "".join(own)
            begun, own = at, []
        elif begun is not None:
            own.append("".join(line.split()))
    if begun is not None:
        yield begun, "".join(own)


class Reader(_Files, DataSourceReader):
    def partitions(self) -> Sequence[Part]:
        return self.parts(self.files())


class StreamReader(_Files, DataSourceStreamReader):
    """Files as they come, by the time of their last change and then name."""

    @staticmethod
    def _key(f: fs.FileInfo) -> list:
        return [f.mtime_ns or 0, f.path]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": [-1, ""]}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"after": max([self._key(f) for f in self.files()], default=[-1, ""])}

    def partitions(self, start: dict, end: dict) -> Sequence[Part]:
        return self.parts([f for f in self.files() if start["after"] < self._key(f) <= end["after"]])

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceArrowWriter):
    """Pairs (a, b) as .seq or .txt files: one for each task, under another name until all tasks are done."""

    def __init__(self, options: dict[str, str], columns: list[str], overwrite: bool):
        files = _Files(options)
        self.path, self.kind, self.overwrite = files.path, files.kind or "seq", overwrite
        if self.kind not in ("seq", "txt"):
            raise ValueError("pairs are written as seq or txt")
        self.a, self.b = columns.index("a"), columns.index("b")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _file_system(self.path)
        system.create_dir(path)
        name = f"{path}/_{uuid.uuid4().hex}"
        first, second = (b">", b"<") if self.kind == "seq" else (b"", b"")
        with system.open_output_stream(name) as out:
            for batch in iterator:
                for a, b in zip(batch.column(self.a).to_pylist(), batch.column(self.b).to_pylist(), strict=True):
                    if a is None or b is None or "\n" in a or "\n" in b:
                        raise ValueError("a pair with a null side or a line end can't be written")
                    out.write(b"%s%s\n%s%s\n" % (first, a.encode(), second, b.encode()))
        return Written([name])

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _file_system(self.path)
        if self.overwrite:
            for f in _Files({"path": self.path}).files():
                system.delete_file(f.path)
        for k, name in enumerate(x for m in messages if m for x in m.files):
            system.move(name, f"{path}/part-{k:05d}-{uuid.uuid4().hex[:8]}.{self.kind}")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _file_system(self.path)
        for name in (x for m in messages if m for x in m.files):
            system.delete_file(name)


class SeqPairs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "seqpairs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SeqPairs)
