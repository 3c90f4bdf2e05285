"""Shared plumbing of the training-data operators: slicing Arrow batches, sizing shuffles, cutting lineage.

Nothing here depends on a table's content.  Slices keep a Python worker's memory in proportion to a few
megabytes of text, whatever the batch size of the session is.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

SLICE_BYTES = 1 << 18
#: Rows of an Arrow batch between Spark and Python, where the session has not chosen a number of its own.
BATCH_ROWS = 500
_written: set[str] = set()
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A-Z to a-z on UTF-8 bytes; every other byte stays.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def prepare(spark: SparkSession) -> None:
    """Make batches of whole texts small, and ship this package to the executors (once a Spark application)."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_array(column: pa.Array) -> pa.Array:
    """The column as large_string with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_slices(batches: Iterable[pa.RecordBatch], column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds at most ``limit`` bytes of the text column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column end to end as bytes, and the n + 1 offsets between them."""
    texts = text_array(column)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def shuffle_parts(df: DataFrame, mb: int = 16) -> int:
    """Partitions for a shuffle of all columns of ``df``: the session's number, or more where the plan's size asks for it."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # a plan without statistics claims a size beyond any table
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(200_000, known // (mb << 20))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none and runs on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="vocalmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and lost executors lose nothing.

    Results read these tables lazily, so they stay until :func:`discard`, or :func:`discard_all` once results are written.
    """
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_dir(spark)}/vocalmill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vocalmill_path = path
    _written.add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _written.discard(path)


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once nothing reads it any more."""
    if path := getattr(df, "_vocalmill_path", None):
        _delete(df.sparkSession, path)


def discard_others(spark: SparkSession, before: set[str], *kept: DataFrame) -> None:
    """Delete the tables written since ``before`` (a copy of the names written by then), but for those of ``kept``."""
    for path in sorted(_written - before - {df._vocalmill_path for df in kept}):
        _delete(spark, path)


def written() -> set[str]:
    """The names of the tables that this process has written and not deleted, for :func:`discard_others`."""
    return set(_written)


def discard_all(spark: SparkSession) -> None:
    """Delete all tables that this process has written and not deleted; for when no result is still to be computed."""
    for path in sorted(_written):
        _delete(spark, path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, so that other columns can't clash with an operator's own."""
    prepare(df.sparkSession)
    return df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
