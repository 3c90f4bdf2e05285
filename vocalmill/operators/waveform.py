"""Waveforms (W7, W8, S10): peaks of samples, and the level of a stretch of time.

A WAV file may be read as one value (:func:`decode_wav`, :func:`wav_peaks`), or, of any length, in ranges of whole chunks that
are dealt over tasks: the headers are read first, a few bytes a file, then each range by its place (:func:`file_peaks`).
Levels of many stretches come from a table of block maxima over powers of two (:func:`pyramid`, :func:`levels`).
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..sources import store

MAX_PEAKS, PEAKS_A_SECOND = 500_000, 180


def chunk_frames(frames: Column, duration: Column, target: int = 120_000) -> Column:
    """Samples for each peak."""
    wanted = F.when(duration > 0, F.least(F.lit(MAX_PEAKS), F.greatest(F.lit(target), (duration * PEAKS_A_SECOND).cast("int")))).otherwise(F.lit(target))
    return F.greatest(F.lit(1), F.floor(frames / F.greatest(wanted, F.lit(1)))).cast("bigint")


def peaks(samples: DataFrame, key: str = "file_id", chunk: Column | int = 1) -> DataFrame:
    """(key, peak_idx, peak): greatest absolute value of each chunk of samples (key, idx, value), over the file's greatest (1 at least)."""
    size = chunk if isinstance(chunk, Column) else F.lit(chunk)
    each = samples.groupBy(key, F.floor(F.col("idx") / size).alias("peak_idx")).agg(F.max(F.abs("value")).alias("top"))
    whole = each.groupBy(key).agg(F.greatest(F.max("top"), F.lit(1)).alias("whole"))
    return each.join(whole, key).select(key, "peak_idx", (F.col("top") / F.col("whole")).alias("peak"))


def level(values: Column, duration: Column, start: Column, end: Column) -> Column:
    """The greatest peak of a stretch of time (seconds); over two peaks or fewer, interpolated."""
    n = F.size(values)
    at = F.greatest(start, F.lit(0.0)) / duration * n
    upto = F.least(duration, end) / duration * n
    first = F.greatest(F.lit(0), F.least(n - 1, at.cast("int")))
    last = F.greatest(first + 1, F.least(n, upto.cast("int") + 1))
    left, right = F.get(values, first), F.get(values, F.least(n - 1, first + 1))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), at - first))
    inside = F.when(last - first <= 2, left + (right - left) * share).otherwise(F.array_max(F.slice(values, first + 1, F.greatest(last - first, F.lit(0)))))
    return F.when((n < 1) | (duration <= 0), F.lit(0.0)).otherwise(inside)


def sample_chunks(data: bytes, frames: int = 65_536) -> Iterator[tuple[int, int, np.ndarray]]:
    """(frame rate, place of the first, samples) of the first channel of a WAV file, so many frames at a time.

    8-bit samples are centred; files of another width, or that can't be read, have none.
    """
    try:
        with wave.open(io.BytesIO(data), "rb") as file:
            width, channels, rate = file.getsampwidth(), max(1, file.getnchannels()), file.getframerate()
            at = 0
            while width in (1, 2, 4) and (raw := file.readframes(frames)):
                raw = raw[: len(raw) // (width * channels) * width * channels]
                values = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width])[::channels].astype(np.int64)
                yield rate, at, values - 128 if width == 1 else values
                at += len(values)
    except (wave.Error, EOFError, struct.error):
        return


def read_samples(data: bytes) -> tuple[int, list[int]]:
    """Frame rate and all samples of the first channel, for short files."""
    rate, out = 0, []
    for rate, _, values in sample_chunks(data):  # noqa: B007
        out += values.tolist()
    return rate, out


def decode_wav(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(file_id, idx, value, rate) for each sample of WAV files read as binary."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["p"], frame["c"], strict=True):
                for rate, start, values in sample_chunks(bytes(data)):
                    yield pd.DataFrame({"file_id": path, "idx": np.arange(start, start + len(values)), "value": values, "rate": rate})

    ship(files.sparkSession)
    return files.select(F.col(path_col).alias("p"), F.col(content_col).alias("c")).mapInPandas(run, "file_id string, idx bigint, value bigint, rate int")


def wav_peaks(files: DataFrame, chunk: int, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(file_id, peak_idx, peak, rate) of WAV files; only a row for each peak leaves the task that reads a file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["p"], frame["c"], strict=True):
                for rate, start, values in sample_chunks(bytes(data), max(1, 65_536 // chunk) * chunk):
                    tops = np.maximum.reduceat(np.abs(values), np.arange(0, len(values), chunk))
                    yield pd.DataFrame({"file_id": path, "peak_idx": start // chunk + np.arange(len(tops)), "top": tops, "rate": rate})

    ship(files.sparkSession)
    each = files.select(F.col(path_col).alias("p"), F.col(content_col).alias("c")).mapInPandas(run, "file_id string, peak_idx bigint, top bigint, rate int")
    whole = F.greatest(F.max("top").over(Window.partitionBy("file_id")), F.lit(1))
    return each.select("file_id", "peak_idx", (F.col("top") / whole).alias("peak"), "rate")


#: Bytes of a range of samples, and peaks in a block of the pyramid.
RANGE_BYTES, BLOCK_PEAKS = 32 << 20, 64
#: Fixed values of the format: tags for samples as whole numbers, and for a tag that stands in the extension.
PCM, EXTENSIBLE = 1, 0xFFFE


def wav_header(file, size: int) -> tuple[int, int, int, int, int] | None:
    """(frame rate, channels, bytes a sample, place of the samples, their bytes) of a WAV file, RF64 too.

    None where it isn't one, or its samples aren't whole numbers of 8, 16 or 32 bits.  Sizes that pass the end of the file,
    as programs leave them that were stopped, end with it.
    """
    head = file.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        return None
    at, long_size, shape = 12, None, None
    while at + 8 <= size:
        file.seek(at)
        tag, length = struct.unpack("<4sI", file.read(8))
        if tag == b"ds64":
            long_size = struct.unpack("<QQ", file.read(16))[1]
        elif tag == b"fmt ":
            body = file.read(min(length, 40))
            if len(body) < 16:
                return None
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind == EXTENSIBLE and len(body) >= 26:
                kind = struct.unpack("<H", body[24:26])[0]
            shape = (rate, channels, (bits + 7) // 8) if kind == PCM and channels else None
        elif tag == b"data":
            if shape is None or shape[2] not in (1, 2, 4):
                return None
            length = long_size if long_size is not None and length == 0xFFFFFFFF else length
            frame = shape[1] * shape[2]
            return (*shape, at + 8, min(length, size - at - 8) // frame * frame)
        at += 8 + length + length % 2
    return None


def wav_headers(files: DataFrame, path_col: str = "path", size_col: str = "length") -> DataFrame:
    """(file_id, rate, channels, width, at, frames) of the WAV files in a listing; others are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, place = store.at(path)
                with files.open_input_file(place) as file:
                    found = wav_header(file, size)
                if found:
                    rate, channels, width, at, length = found
                    rows.append((path, rate, channels, width, at, length // (channels * width)))
            yield pa.RecordBatch.from_pylist([dict(zip(_HEADER.names, r, strict=True)) for r in rows], schema=_HEADER)

    ship(files.sparkSession)
    return files.select(F.col(path_col).cast("string").alias("p"), F.col(size_col).cast("bigint").alias("s")).mapInArrow(run, "file_id string, rate int, channels int, width int, at bigint, frames bigint")


_HEADER = pa.schema([("file_id", pa.string()), ("rate", pa.int32()), ("channels", pa.int32()), ("width", pa.int32()), ("at", pa.int64()), ("frames", pa.int64())])
_TOPS = pa.schema([("file_id", pa.string()), ("rate", pa.int32()), ("peak_idx", pa.int64()), ("top", pa.int64())])


def file_peaks(files: DataFrame, chunk: Column | int | None = None, path_col: str = "path", size_col: str = "length", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file_id, peak_idx, peak, rate) of listed WAV files, each read in ranges of about ``range_bytes`` that are dealt over tasks.

    ``chunk`` is the number of samples for each peak, as a number or a column over (rate, frames); without it the rule
    of :func:`chunk_frames` holds.  A range is a whole number of chunks, so each peak comes from one task.
    """
    size = chunk_frames(F.col("frames"), F.col("frames") / F.col("rate")) if chunk is None else chunk if isinstance(chunk, Column) else F.lit(chunk)
    sized = wav_headers(files, path_col, size_col).where("frames > 0").withColumn("chunk", size.cast("bigint"))
    step = F.greatest(F.lit(1), F.floor(F.lit(range_bytes) / (F.col("chunk") * F.col("channels") * F.col("width")))) * F.col("chunk")
    ranges = sized.withColumn("step", step.cast("bigint")).withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("frames") - 1, F.col("step"))))
    ranges = ranges.select("file_id", "rate", "channels", "width", "chunk", (F.col("at") + F.col("first") * F.col("channels") * F.col("width")).alias("at"), "first", F.least("step", F.col("frames") - F.col("first")).alias("many"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tops = _range_tops(r)
                many = len(tops)
                columns = [pa.array([r["file_id"]] * many), pa.array([r["rate"]] * many, pa.int32()), pa.array(r["first"] // r["chunk"] + np.arange(many)), pa.array(tops)]
                yield pa.RecordBatch.from_arrays(columns, schema=_TOPS)

    spread = ranges.repartition(F.col("file_id"), F.col("first"))
    each = spread.mapInArrow(run, "file_id string, rate int, peak_idx bigint, top bigint")
    whole = each.groupBy("file_id").agg(F.greatest(F.max("top"), F.lit(1)).alias("whole"))
    return each.join(whole, "file_id").select("file_id", "peak_idx", (F.col("top") / F.col("whole")).alias("peak"), "rate")


def _range_tops(r: dict) -> np.ndarray:
    """The greatest absolute value of the first channel in each chunk of a range, read a megabyte or a chunk at a time."""
    frame = r["channels"] * r["width"]
    kind = {1: np.uint8, 2: "<i2", 4: "<i4"}[r["width"]]
    step = max(1, (1 << 20) // (frame * r["chunk"])) * r["chunk"]
    files, place = store.at(r["file_id"])
    tops = []
    with files.open_input_file(place) as file:
        for start in range(0, r["many"], step):
            many = min(step, r["many"] - start)
            values = np.frombuffer(file.read_at(many * frame, r["at"] + start * frame), kind)[:: r["channels"]].astype(np.int64)
            tops.append(np.maximum.reduceat(np.abs(values - 128 if r["width"] == 1 else values), np.arange(0, len(values), r["chunk"])))
    return np.concatenate(tops)


def pyramid(peaks: DataFrame, key: str = "file_id", block: int = BLOCK_PEAKS) -> DataFrame:
    """(key, level, idx, values): level 0 has blocks of ``block`` peaks; at level k + 1 ``values`` is the one greatest peak of the 2**k blocks from idx on."""
    blocks = peaks.groupBy(key, F.floor(F.col("peak_idx") / block).alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("peak_idx", "peak"))), lambda x: x["peak"]).alias("values"))
    tops = blocks.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.array_max("values").alias("top")))), lambda x: x["top"]).alias("tops"))
    power = lambda k: F.call_function("shiftleft", F.lit(1), k)

    def longer(rows: Column, k: Column) -> Column:
        last, half = F.element_at(rows, -1), power(k - 1)
        many = F.size(last) - half
        return F.when(many < 1, rows).otherwise(F.concat(rows, F.array(F.zip_with(F.slice(last, F.lit(1), F.greatest(many, F.lit(0))), F.slice(last, half + 1, F.greatest(many, F.lit(0))), lambda a, b: F.greatest(a, b)))))

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size("tops").cast("double"))).cast("int")))
    rows = tops.select(key, F.posexplode(F.aggregate(steps, F.array("tops"), longer)).alias("k", "row")).select(key, "k", F.posexplode("row").alias("idx", "top"))
    upper = rows.select(key, (F.col("k") + 1).alias("level"), F.col("idx").cast("bigint").alias("idx"), F.array("top").alias("values"))
    return blocks.select(key, F.lit(0).alias("level"), "idx", "values").unionByName(upper)


def levels(stretches: DataFrame, peaks: DataFrame, files: DataFrame, key: str = "file_id", block: int = BLOCK_PEAKS) -> DataFrame:
    """W8 for many stretches (key, id, start, end in seconds) of files (key, duration): (key, id, level), as :func:`level` has it.

    ``peaks`` has key, peak_idx (from 0, without gaps) and peak; ``id`` is unique within a file.  A stretch meets at most four
    rows of the pyramid, by (file, level, place), so a file that all ask about is dealt over many tasks.
    """
    table = pyramid(peaks, key, block)
    sizes = peaks.groupBy(key).agg(F.count("*").alias("n"))
    known = files.select(key, "duration").join(sizes, key, "left")
    asked = stretches.select(key, "id", "start", "end").join(known, key, "left")
    n, duration = F.coalesce("n", F.lit(0)).cast("bigint"), F.col("duration").cast("double")
    at = F.greatest(F.col("start"), F.lit(0.0)) / duration * n
    upto = F.least(duration, F.col("end")) / duration * n
    usable = F.coalesce((n > 0) & (duration > 0), F.lit(False))
    clamp = lambda low, x, high: F.greatest(low, F.least(high, x))
    first = F.when(usable, clamp(F.lit(0), F.floor(at).cast("bigint"), n - 1))
    asked = asked.withColumn("usable", usable).withColumn("first", first).withColumn("n", n).withColumn("share", F.when(usable, clamp(F.lit(0.0), at - first, F.lit(1.0))))
    # the first place is cut towards zero and so is the end, as times are not negative
    asked = asked.withColumn("last", F.when(usable, F.greatest(F.col("first") + 1, F.least(F.col("n"), F.when(upto < 0, F.ceil(upto)).otherwise(F.floor(upto)).cast("bigint") + 1))))
    short = F.col("last") - F.col("first") <= 2
    end = F.when(short, F.least(F.col("n"), F.col("first") + 2)).otherwise(F.col("last"))
    place = lambda p: F.floor(p / F.lit(block)).cast("bigint")
    b1, b2 = place(F.col("first")), place(F.col("stop") - 1)
    inner = b2 - b1 - 1  # whole blocks between those of the two ends
    k = F.when(inner > 0, F.floor(F.log2(inner.cast("double"))).cast("int"))
    row = lambda what, level, idx, skip, many: F.struct(F.lit(what).alias("what"), level.cast("int").alias("level"), idx.alias("idx"), skip.cast("int").alias("skip"), many.cast("int").alias("many"))
    zero, one = F.lit(0), F.lit(1)
    one_value = lambda what, p: row(what, zero, place(p), p - place(p) * block, one)
    ends = F.array(
        F.when(~short, row("m", zero, b1, F.col("first") - b1 * block, F.least(F.lit(block), F.col("stop") - b1 * block) - (F.col("first") - b1 * block))),
        F.when(~short & (b2 > b1), row("m", zero, b2, zero, F.col("stop") - b2 * block)),
        F.when(~short & (inner > 0), row("m", k + 1, b1 + 1, zero, one)),
        F.when(~short & (inner > 0), row("m", k + 1, b2 - F.call_function("shiftleft", F.lit(1).cast("bigint"), k), zero, one)),
        F.when(short, one_value("l", F.col("first"))),
        F.when(short, one_value("r", F.col("stop") - 1)),
    )
    parts = asked.withColumn("stop", end).select(key, "id", "usable", "share", F.explode_outer(F.when(F.col("usable"), F.array_compact(ends))).alias("r")).select(key, "id", "usable", "share", "r.*")
    met = parts.join(table.withColumnRenamed("values", "v"), [key, "level", "idx"], "left")
    value = F.array_max(F.slice("v", F.col("skip") + 1, F.greatest(F.col("many"), F.lit(0))))
    of = lambda what: F.max(F.when(F.col("what") == what, value))
    found = met.groupBy(key, "id").agg(of("m").alias("m"), of("l").alias("l"), of("r").alias("r"), F.max("share").alias("share"))
    return found.select(key, "id", F.coalesce("m", F.col("l") + (F.col("r") - F.col("l")) * F.col("share"), F.lit(0.0)).alias("level"))
