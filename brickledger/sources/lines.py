"""Lines of files by their byte ranges, for names that Spark's file readers pass over."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20
_CHUNK = 1 << 20
_BATCH_LINES = 4096


def open_file(path: str) -> pa.NativeFile:
    """A path as Hadoop writes it (scheme:/path, not escaped), opened for random access."""
    scheme, _, rest = path.rpartition(":") if ":" in path.split("/", 1)[0] else ("file", "", path)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, inner = fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
    return system.open_input_file(inner)


def lines_of(file, begin: int, end: int, chunk: int = _CHUNK) -> Iterator[tuple[int, bytes]]:
    """(start, line) for the lines that start in begin .. end - 1, without their line ends; no more than needed is read."""
    start = begin
    if begin:  # the line that holds the byte before belongs to the range before, unless that byte ends it
        file.seek(begin - 1)
        while True:
            block = file.read(chunk)
            if not block:
                return
            at = block.find(b"\n")
            if at >= 0:
                start = file.tell() - len(block) + at + 1
                break
    file.seek(start)
    parts: list[bytes] = []  # the pieces of the line under way, joined once it ends
    while start < end:
        block = file.read(chunk)
        if not block:
            line = b"".join(parts)
            if line:
                yield start, line.removesuffix(b"\r")
            return
        *whole, rest = block.split(b"\n")
        for piece in whole:
            if start >= end:
                return
            line = b"".join([*parts, piece])
            parts.clear()
            yield start, line.removesuffix(b"\r")
            start += len(line) + 1
        parts.append(rest)


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        super().__init__((path, begin, end))


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[_Range]:
        return [
            _Range(path, begin, min(begin + self.range_bytes, length))
            for path, length in self.files for begin in range(0, length, self.range_bytes)
        ]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        path, begin, end = partition.value
        starts, values = [], []

        def batch() -> pa.RecordBatch:
            columns = [pa.array([path] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["path", "start", "value"])

        with open_file(path) as file:
            for start, line in lines_of(file, begin, end):
                starts.append(start)
                values.append(line)
                if len(starts) >= _BATCH_LINES:
                    yield batch()
                    starts, values = [], []
        if starts:
            yield batch()


class LineRanges(DataSource):
    """(path, start, value) of all lines of the files in the option ``files``, a JSON list of [path, length].

    Files are split into ranges of ``rangeBytes`` bytes, one task each; each line is read by the range it starts in.
    Any store that Arrow opens by its address will do.
    """

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return "path string, start long, value binary"

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options)
