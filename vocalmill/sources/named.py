"""Named files, a row each: a sink, all of them there after the commit or none (K4-K7, K10, K11, K13), and a reader.

``df.write.format("named_files")`` takes rows (name, content), the content text or bytes.  A task writes its files into a
folder of its own below ``.staging-<job>``; the commit moves them to their names and writes ``_SUCCESS`` last, an abort
deletes the staging folder.  So a task that is tried again, or runs twice, leaves one file, and a job that fails leaves
what was there before.  Each file is whole at any time.

Modes: ``append`` puts files under their names, replacing those of the same name; ``overwrite`` also deletes other files
in the folder.  A null content is an empty file.  A name that is null, empty, hidden or has a slash, and a name that two
rows share, fail the job, with nothing written.  The driver sees the names of the files, not their contents.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship
from . import store

#: Files moved at a time by a commit, where a move is a request to a store; on a disk, threads only hinder each other.
MOVERS = 16
#: What a task reads at most, but for a single larger file, and the bytes and files of a batch.
PARTITION_FILES, PARTITION_BYTES, BATCH_FILES, BATCH_BYTES = 2048, 32 << 20, 512, 4 << 20


@dataclass
class Staged(WriterCommitMessage):
    """A task's folder and the names in it."""

    folder: str
    names: list[str]


class NamedWriter(DataSourceArrowWriter):
    """Writes, commits and aborts one job."""

    def __init__(self, uri: str, overwrite: bool):
        self.uri, self.overwrite = uri, overwrite
        self.staging = f".staging-{uuid.uuid4().hex}"

    def _base(self):
        files, base = store.at(self.uri)
        return files, base.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, base = self._base()
        folder = f"{base}/{self.staging}/{TaskContext.get().taskAttemptId()}"
        names: list[str] = []
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not name or "/" in name or name.startswith((".", "_")):
                    raise ValueError(f"not a file's name: {name!r}")
                if not names:
                    files.create_dir(folder)
                value = content.as_py() if content.is_valid else b""
                with files.open_output_stream(f"{folder}/{name}", compression=None) as out:
                    out.write(value.encode() if isinstance(value, str) else value)
                names.append(name)
        return Staged(folder, names)

    def commit(self, messages: list[Staged | None]) -> None:
        files, base = self._base()
        staged = [(m.folder, name) for m in messages if m is not None for name in m.names]
        names = {name for _, name in staged}
        if len(names) < len(staged):
            self.abort(messages)
            raise ValueError("two rows have the same file name")
        files.create_dir(base)
        movers = 1 if isinstance(files, fs.LocalFileSystem) else MOVERS
        with ThreadPoolExecutor(movers) as pool:

            def each(do: Callable, items: list) -> None:
                """A share of the items a mover: handing them over one by one takes longer than a move on a disk."""
                list(pool.map(lambda k: [do(x) for x in items[k::movers]], range(movers)))

            each(lambda f: files.move(f"{f[0]}/{f[1]}", f"{base}/{f[1]}"), staged)
            if self.overwrite:
                each(files.delete_file, [p for p, _ in store.files(self.uri) if posixpath.basename(p) not in names])
        self.abort(messages)
        with files.open_output_stream(f"{base}/_SUCCESS") as out:
            out.write(b"")

    def abort(self, messages: list[Staged | None]) -> None:
        files, base = self._base()
        if files.get_file_info(f"{base}/{self.staging}").type.name == "Directory":
            files.delete_dir(f"{base}/{self.staging}")


@dataclass
class Some(InputPartition):
    """Names in a folder that a task reads."""

    folder: str
    names: list[str]


def dealt(found: list[tuple[str, int]]) -> list[Some]:
    """(path, size) of files in one folder as the shares of tasks."""
    parts: list[Some] = []
    room = 0
    for path, size in found:
        folder, name = posixpath.split(path)
        if not parts or size > room or len(parts[-1].names) == PARTITION_FILES:
            parts.append(Some(folder, []))
            room = PARTITION_BYTES
        parts[-1].names.append(name)
        room -= size
    return parts


class NamedReader(DataSourceReader):
    """Files of a folder, by name."""

    def __init__(self, uri: str, ending: str):
        self.uri, self.ending = uri, ending

    def partitions(self) -> list[Some]:
        store.existing(self.uri)
        return dealt(store.files(self.uri, self.ending))

    def read(self, partition: Some | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # how Spark reads a folder without files
            return
        files, _ = store.at(self.uri)
        names, contents, size = [], [], 0
        for name in partition.names:
            with files.open_input_file(f"{partition.folder}/{name}") as file:
                content = file.read()
            if names and (size + len(content) > BATCH_BYTES or len(names) == BATCH_FILES):
                yield self._batch(names, contents)
                names, contents, size = [], [], 0
            names.append(name)
            contents.append(content)
            size += len(content)
        yield self._batch(names, contents)

    @staticmethod
    def _batch(names: list[str], contents: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])


class NamedFiles(DataSource):
    """The data source ``named_files``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def reader(self, schema: StructType) -> NamedReader:
        return NamedReader(self.options["path"], self.options.get("ending", ""))

    def writer(self, schema: StructType, overwrite: bool) -> NamedWriter:
        return NamedWriter(self.options["path"], overwrite)


def write(files: DataFrame, path: str, ending: str, key: str = "interview_id", mode: str = "append") -> None:
    """Write (key, content) as ``<key><ending>`` into the folder ``path``."""
    spark = files.sparkSession
    ship(spark)
    spark.dataSource.register(NamedFiles)
    rows = files.select(F.concat(F.col(key).cast("string"), F.lit(ending)).alias("name"), F.col("content").cast("binary").alias("content"))
    rows.write.format("named_files").mode(mode).save(path)


def read(spark: SparkSession, path: str, ending: str = "") -> DataFrame:
    """(name, content) of the files in the folder ``path`` whose names end in ``ending``, content as bytes."""
    ship(spark)
    spark.dataSource.register(NamedFiles)
    return spark.read.format("named_files").option("ending", ending).load(path)
