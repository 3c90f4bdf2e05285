"""Logs that grow in place, as a stream (ST1, S11): a data source whose offsets are files and bytes.

Spark's own file stream reads a file once, when it is new; a job log is one file to which lines are appended.  Here an
offset holds, for each file of the folder (or the one file), how many bytes are read, always up to the end of a whole line:
a line that is being written waits for its line break.  A batch takes what has been appended since, from all files, in
partitions of ``partitionBytes``; a line belongs to the partition in which it begins.  ``maxBytesPerTrigger`` bounds what a
batch takes from each file (a single longer line apart), but for the first batch of a stream; then a trigger for what is
available takes one such batch, too.  A file that has become shorter was
begun anew and is read from its start; one that was begun anew and has grown beyond its old size can't be told from one that grew.

The rows are (path, position, value): the line without its line break; blank lines are left out, bytes that are no UTF-8
are replaced.  Offsets are in the checkpoint, so each line is read once, also after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..session import ship
from . import store

PARTITION_BYTES, BLOCK, ROWS = 32 << 20, 1 << 16, 4096


@dataclass
class Range(InputPartition):
    """The lines of a file that begin at ``start`` or later and before ``end``."""

    path: str
    start: int
    end: int
    first: bool


def line_end(file, start: int, upto: int) -> int:
    """The place after the last line break in bytes ``start`` to ``upto``; ``start`` if there is none."""
    while upto > start:
        low = max(start, upto - BLOCK)
        file.seek(low)
        found = file.read(upto - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        upto = low
    return start


def next_line(file, start: int, size: int) -> int:
    """The place after the first line break from ``start`` on; ``size`` if there is none."""
    file.seek(start)
    while start < size:
        data = file.read(min(BLOCK, size - start))
        if not data:
            break
        found = data.find(b"\n")
        if found >= 0:
            return start + found + 1
        start += len(data)
    return size


def lines(file, part: Range, size: int) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin in the range, without their line breaks."""
    at = part.start if part.first else next_line(file, part.start - 1, size)
    file.seek(at)
    rest = b""
    while at < part.end:
        data = file.read(BLOCK)
        rest += data
        *whole, rest = rest.split(b"\n")
        if not data and rest:
            whole, rest = [rest], b""
        for line in whole:
            if at >= part.end:
                return
            yield at, line
            at += len(line) + 1
        if not data:
            return


class GrowingReader(DataSourceStreamReader):
    """Offsets: {path: bytes read}."""

    def __init__(self, options: dict):
        self.uri, self.ending = options["path"], options.get("ending", "")
        self.piece, self.limit = int(options.get("partitionBytes", PARTITION_BYTES)), int(options.get("maxBytesPerTrigger", 1 << 62))
        self.known: dict[str, int] | None = None  # what Spark last said has been read; it says nothing before the first batch

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Further on from the last offset, by at most the limit a file, or one line where that is longer."""
        files, _ = store.at(self.uri)
        now = dict(self.known or {})
        for path, size in store.files(self.uri, self.ending):
            start = now.get(path, 0)
            start = 0 if size < start else start
            if size > start:
                with files.open_input_file(path) as file:
                    upto = size if self.known is None else min(size, start + self.limit)
                    end = line_end(file, start, upto)
                    if end == start and upto < size:
                        end = line_end(file, start, next_line(file, upto, size))
                if end > start:
                    now[path] = end
        return now

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.known = {**(self.known or {}), **end}
        out = []
        for path, upto in sorted(end.items()):
            begin = start.get(path, 0)
            begin = 0 if upto < begin else begin
            cuts = [*range(begin, upto, self.piece), upto]
            out += [Range(path, a, b, a == begin) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, _ = store.at(self.uri)
        size = files.get_file_info(partition.path).size
        rows: list[tuple[int, bytes]] = []
        with files.open_input_file(partition.path) as file:
            for at, line in lines(file, partition, size):
                if line.strip():
                    rows.append((at, line))
                if len(rows) >= ROWS:
                    yield _batch(partition.path, rows)
                    rows = []
        if rows:
            yield _batch(partition.path, rows)

    def commit(self, end: dict) -> None:
        self.known = {**(self.known or {}), **end}


def _batch(path: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    values = [line.removesuffix(b"\r").decode("utf-8", "replace") for _, line in rows]
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([at for at, _ in rows], pa.int64()), pa.array(values, pa.string())], names=["path", "position", "value"])


class GrowingLog(DataSource):
    """The data source ``growing_log``."""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return "path string, position bigint, value string"

    def streamReader(self, schema: StructType) -> GrowingReader:
        return GrowingReader(self.options)


def stream(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """The lines of a growing log (a file, or all in a folder) as a stream; with a schema, as JSON: its columns, with path and position."""
    ship(spark)
    spark.dataSource.register(GrowingLog)
    rows = spark.readStream.format("growing_log").options(path=path, **options).load()
    if schema is None:
        return rows
    return rows.select("path", "position", F.from_json("value", schema).alias("r")).select("path", "position", "r.*")
