"""Readers (S1-S9, S11, S12): listings, CSV, lenient JSON of recognisers, speaker spans, probes, settings, job logs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import media as M
from ..functions.text import blank_to_null, collapse
from ..functions.timecode import to_ms
from ..schemas import LOG, PROBE_COLUMNS
from . import named


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table."""
    return spark.read.parquet(path)


def listing(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, size, mtime) of files; contents are not read.  Paths are without the scheme of the local file system."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(path)
    return files.select(F.regexp_replace("path", "^file:(//)?(?=/)", "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def csv_table(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """S3: a CSV file with a header, all columns strings by name, empty cells empty strings; a byte order mark is skipped."""
    raw = spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"', enforceSchema=False, encoding="UTF-8")
    have = {c.lstrip("﻿"): c for c in raw.columns}
    return raw.select(*(F.coalesce(F.col(f"`{have[f.name]}`"), F.lit("")).alias(f.name) if f.name in have else F.lit("").alias(f.name) for f in schema))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, document, corrupt): whole files as text; corrupt if Spark finds no JSON object in it."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))
    return files.withColumn("corrupt", F.json_object_keys("document").isNull())


def _finite(text: Column) -> Column:
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(1e15)), value)


def _parsed(rows: DataFrame, keep: list[str], elements: Column, place: str, fields: str) -> DataFrame:
    """(keep, place, s): a row for each element that is a JSON object, parsed.

    Parsed inside the array, ahead of the explode: a filter on fields of ``s`` would else be pushed below the projection
    that parses, and each field that it names would be parsed on its own.  The outer explode keeps the optimizer from
    asking beforehand whether the array is empty, which would parse it once more.
    """
    each = F.transform(elements, lambda j: F.when(F.trim(j).startswith("{"), F.from_json(j, fields)))
    return rows.select(*keep, F.posexplode_outer(each).alias(place, "s")).where("s IS NOT NULL")


def asr_segments(documents: DataFrame, key: str = "interview_id", document: str = "document") -> DataFrame:
    """The segments of recognisers' JSON documents, malformed parts left out.

    Elements that are no objects, texts that are blank, and times that are missing or not finite drop the segment;
    swapped times are put right.  Result: key, idx, start_ms, end_ms, speaker, text, needs_review, note, avg_logprob,
    words array<string> (JSON).
    """
    fields = "start string, end string, text string, speaker string, avg_logprob string, needs_speaker_review boolean, diarization_review_note string, words array<string>"
    elements = F.from_json(document, "segments array<string>")["segments"]
    rows = _parsed(documents, [key], elements, "idx", fields).select(key, "idx", "s.*")
    start, end = _finite(F.col("start")), _finite(F.col("end"))
    rows = rows.withColumns({"__a": start, "__b": end}).where("__a IS NOT NULL AND __b IS NOT NULL")
    return rows.select(
        key,
        "idx",
        to_ms(F.least("__a", "__b")).alias("start_ms"),
        to_ms(F.greatest("__a", "__b")).alias("end_ms"),
        "speaker",
        collapse(F.coalesce("text", F.lit(""))).alias("text"),
        F.coalesce("needs_speaker_review", F.lit(False)).alias("needs_review"),
        F.col("diarization_review_note").alias("note"),
        _finite(F.col("avg_logprob")).alias("avg_logprob"),
        "words",
    ).where("text != ''")


def asr_words(segments: DataFrame, key: str = "interview_id", usable_only: bool = True) -> DataFrame:
    """(key, idx, widx, start_ms, end_ms, word, score) from the segments' words.

    Elements that are no objects, blank words and words without numeric times are left out; with ``usable_only`` so
    are words that don't end after their start, otherwise swapped times are put right (P32).
    """
    rows = _parsed(segments, [key, "idx"], F.col("words"), "widx", "word string, text string, start string, end string, score string, probability string").withColumnRenamed("s", "w")
    text = F.trim(F.coalesce(blank_to_null(F.col("w.word")), F.col("w.text"), F.lit("")))
    a, b = _finite(F.col("w.start")), _finite(F.col("w.end"))
    rows = rows.select(key, "idx", "widx", a.alias("a"), b.alias("b"), text.alias("word"), F.coalesce(_finite(F.col("w.score")), _finite(F.col("w.probability"))).alias("score"))
    rows = rows.where("a IS NOT NULL AND b IS NOT NULL AND word != ''")
    if usable_only:
        rows = rows.where("b > a")
    return rows.select(key, "idx", "widx", to_ms(F.least("a", "b")).alias("start_ms"), to_ms(F.greatest("a", "b")).alias("end_ms"), "word", "score")


def spans(documents: DataFrame, key: str = "interview_id", document: str = "document") -> DataFrame:
    """(key, idx, start_ms, end_ms, speaker) of diarization documents; a missing end is the start."""
    outer = documents.select(key, F.from_json(document, "segments array<string>").alias("d"))
    each = outer.select(key, F.posexplode("d.segments").alias("idx", "j")).where(F.trim("j").startswith("{"))
    rows = each.select(key, "idx", F.from_json("j", "start string, end string, speaker string").alias("s"))
    start = F.coalesce(_finite(F.col("s.start")), F.lit(0.0))
    end = F.coalesce(F.nullif(_finite(F.col("s.end")), F.lit(0.0)), start)
    return rows.select(key, "idx", to_ms(start).alias("start_ms"), to_ms(end).alias("end_ms"), F.coalesce("s.speaker", F.lit("")).alias("speaker"))


def find_documents(files: DataFrame, ids: DataFrame, patterns: tuple[str, ...] = ("{id}.json", "json/{id}.json", "json/{id}.whisperx.json"), loose: bool = False, key: str = "interview_id") -> DataFrame:
    """(key, path): the first existing candidate of each recording; ``loose`` also takes names that contain the id, last.

    Candidates are matched by file name, so this is an equi join; the loose one compares ids with all names.
    """
    name = F.substring_index("path", "/", -1)
    candidates = None
    for rank, pattern in enumerate(patterns):
        folder, _, file = pattern.rpartition("/")
        before, after = file.split("{id}")
        ours = files.where(name.startswith(before) & name.endswith(after)).select(F.substring(name, F.lit(len(before) + 1), F.length(name) - len(before) - len(after)).alias(key), "path", F.lit(rank).alias("rank"))
        if folder:
            ours = ours.where(F.substring_index(F.substring_index("path", "/", -2), "/", 1) == folder)
        candidates = ours if candidates is None else candidates.unionByName(ours)
    found = candidates.join(ids.select(key), key, "left_semi")
    if loose:
        tokens = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all(name, F.lit(r"([A-Za-z0-9_-]+)")))).alias(key))
        found = found.unionByName(tokens.join(ids.select(key), key, "left_semi").select(key, "path", F.lit(len(patterns)).alias("rank")))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("rank", "path"))
    return found.withColumn("nth", nth).where("nth = 1").select(key, "path")


def probe_metadata(documents: DataFrame, key: str = "path", document: str = "document") -> DataFrame:
    """The technical columns of ffprobe JSON: the first audio and the first video stream, and the container."""
    stream = "codec_type string, codec_name string, sample_rate string, channels string, channel_layout string, bit_rate string, width string, height string, avg_frame_rate string"
    d = F.from_json(document, f"streams array<struct<{stream.replace(' string', ':string')}>>, format struct<duration:string,format_name:string,format_long_name:string,bit_rate:string>")
    rows = documents.select(key, d.alias("d")).withColumns({kind: F.expr(f"filter(d.streams, s -> s.codec_type = '{kind}')") for kind in ("audio", "video")})
    a, v = F.try_element_at("audio", F.lit(1)), F.try_element_at("video", F.lit(1))
    text = lambda c: F.coalesce(c, F.lit(""))
    values = {
        "duration_sec": M.number_text(F.col("d.format.duration")),
        "source_audio_streams": F.coalesce(F.array_size("audio"), F.lit(0)).cast("string"),
        "source_audio_codec": text(a["codec_name"]),
        "source_sample_rate": text(a["sample_rate"]),
        "source_audio_channels": text(a["channels"]),
        "source_channel_layout": text(a["channel_layout"]),
        "source_bit_rate": text(F.coalesce(a["bit_rate"], F.col("d.format.bit_rate"))),
        "source_video_streams": F.coalesce(F.array_size("video"), F.lit(0)).cast("string"),
        "source_video_codec": text(v["codec_name"]),
        "source_video_width": text(v["width"]),
        "source_video_height": text(v["height"]),
        "source_video_frame_rate": text(M.frame_rate_text(v["avg_frame_rate"])),
        "source_format_name": text(F.col("d.format.format_name")),
        "source_format_long_name": text(F.col("d.format.format_long_name")),
        "probe_status": F.when(F.col("d.format").isNull() & F.col("d.streams").isNull(), F.lit("failed")).otherwise(F.lit("ok")),
    }
    return rows.select(key, *(values[c].alias(c) for c in PROBE_COLUMNS))


def named_files(spark: SparkSession, path: str, ending: str, key: str = "interview_id") -> DataFrame:
    """(key, content) of the files ``<key><ending>`` in a folder, as text."""
    found = named.read(spark, path, ending)
    return found.select(F.substring(F.col("name"), F.lit(1), F.length("name") - len(ending)).alias(key), F.col("content").cast("string").alias("content"))


def named_tables(spark: SparkSession, path: str, ending: str, columns: list[str], sep: str = ",") -> DataFrame:
    """S3: the rows of the delimited files in a folder whose names end in ``ending``, each file by its own header.

    All columns are text; cells that a row or a file lacks are empty.  A byte order mark and blank lines are skipped, a
    quoted cell may have line breaks.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv
        import io

        csv.field_size_limit((1 << 31) - 1)
        for batch in batches:
            cells: list[list[str]] = [[] for _ in columns]
            for content in batch.column(0):
                table = csv.reader(io.StringIO(content.as_py().decode("utf-8-sig", "replace"), newline=""), delimiter=sep)
                head = next((row for row in table if row), [])
                places = [head.index(c) if c in head else len(head) for c in columns]
                for row in table:
                    if row:
                        for column, k in zip(cells, places, strict=True):
                            column.append(row[k] if k < min(len(row), len(head)) else "")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cells], names=columns)

    return named.read(spark, path, ending).select("content").mapInArrow(rows, T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def job_log(spark: SparkSession, path: str) -> DataFrame:
    """Job events from JSON lines; unknown fields are left out, missing ones null."""
    return spark.read.schema(LOG).json(path)


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.lower() in ("", "null", "none", "~"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text[0] == "[" and text[-1] == "]":
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    try:
        return float(text)
    except ValueError:
        return text


def parse_settings(text: str) -> dict:
    """Settings from JSON, or from lines ``key: value`` and ``- item``; ``#`` starts a comment anywhere in a line."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out: dict = {}
    key = None
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].rstrip()
        if not line.strip():
            continue
        if line.lstrip().startswith("- ") and key is not None:
            if not isinstance(out[key], list):
                out[key] = []
            out[key].append(_scalar(line.lstrip()[2:]))
        elif ":" in line:
            key, _, value = line.partition(":")
            key = key.strip()
            out[key] = _scalar(value)
    return out


def settings(path: str, defaults: dict | None = None) -> dict:
    """A settings file over defaults; unknown keys stay."""
    return {**(defaults or {}), **parse_settings(Path(path).read_text(encoding="utf-8-sig"))}
