"""Writers (K1-K15): each output is a DataFrame of lines or rows first, so it can be checked and written by any sink."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.timecode import clock, cue_end, seconds_text, timecode
from ..operators.turns import blocks
from ..schemas import TURN_COLUMNS
from ..session import ship
from . import named

LOG = logging.getLogger(__name__)
BOM = "﻿"
#: Folders whose files are shown to users.
SHOWN_FOLDERS = ("docx", "md", "srt", "vtt", "csv", "tsv")


def _start() -> Column:
    return F.coalesce("start_ms", F.lit(0))


def _in_order(turns: DataFrame, lines: Column, by: str, key: str, glue: str, head: str = "") -> DataFrame:
    """(key, content): the lines of each recording in order, joined, with a line break at the end."""
    grouped = turns.select(key, by, lines.alias("line")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(by, "line"))).alias("l"))
    return grouped.select(key, F.concat(F.lit(head), F.rtrim(F.array_join("l.line", glue)), F.lit("\n")).alias("content"))


def cues(turns: DataFrame, mark: str = ",", key: str = "interview_id") -> DataFrame:
    """(key, cue from 1, times, text) of turns that have a text or flags."""
    text = X.subtitle_text(F.col("human_label"), F.col("speaker"), F.col("text"), F.col("flags"))
    shown = turns.where(X.shows(F.col("text"), F.col("flags"))).withColumn("body", text)
    times = F.concat(timecode(_start(), mark), F.lit(" --> "), timecode(cue_end(_start(), F.col("end_ms")), mark))
    return shown.select(key, F.row_number().over(Window.partitionBy(key).orderBy("turn")).alias("cue"), times.alias("times"), F.col("body").alias("text"))


def srt(turns: DataFrame, key: str = "interview_id") -> DataFrame:
    """K6: (key, content) of SRT files."""
    return _in_order(cues(turns, ",", key), F.concat_ws("\n", F.col("cue").cast("string"), "times", "text"), "cue", key, "\n\n")


def vtt(turns: DataFrame, key: str = "interview_id") -> DataFrame:
    """K7: (key, content) of WebVTT files."""
    return _in_order(cues(turns, ".", key), F.concat_ws("\n", "times", "text"), "cue", key, "\n\n", "WEBVTT\n\n")


def turn_rows(turns: DataFrame, key: str = "interview_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """K8: the eleven columns of the turns table, all text; ``keep`` names columns of the turns to carry along."""
    end = cue_end(_start(), F.col("end_ms"))
    given = X.blank_to_null(F.col("turn_id")) if "turn_id" in turns.columns else F.lit(None).cast("string")
    nth = F.row_number().over(Window.partitionBy(key).orderBy("turn"))
    values = [
        F.col(key).cast("string"), F.coalesce(given, F.format_string("turn_%06d", nth)), seconds_text(_start()), seconds_text(end), timecode(_start()), timecode(end),
        F.coalesce("speaker", F.lit("")), F.coalesce("human_label", F.lit("")), F.array_join(X.clean_flags(F.col("flags")), ";"), F.coalesce("notes", F.lit("")), X.collapse(F.coalesce("text", F.lit(""))),
    ]
    return turns.select(*keep, *(v.alias(c) for v, c in zip(values, TURN_COLUMNS, strict=True)))


def nvivo_rows(turns: DataFrame, key: str = "interview_id") -> DataFrame:
    """K9: (key, turn, Timespan, Speaker, Content)."""
    content = X.join_text(X.collapse(F.coalesce("text", F.lit(""))), X.flag_text(F.col("flags")))
    span = F.concat(timecode(_start()), F.lit("-"), timecode(F.coalesce("end_ms", F.lit(0))))
    return turns.select(key, "turn", span.alias("Timespan"), F.coalesce(X.blank_to_null(F.col("human_label")), F.col("speaker")).alias("Speaker"), content.alias("Content"))


def markdown(turns: DataFrame, key: str = "interview_id") -> DataFrame:
    """K5: (key, content): a heading, then each block with its start and speaker, paragraphs apart."""
    shown = blocks(turns, key)  # every block has a text, hence a paragraph
    first = F.concat(F.lit("["), clock(F.col("start_ms")), F.lit("] **"), "label", F.lit(":** "), F.get("paragraphs", F.lit(0)))
    line = F.concat_ws("\n\n", first, F.slice("paragraphs", 2, F.greatest(F.size("paragraphs") - 1, F.lit(0))))
    body = _in_order(shown, line, "block", key, "\n\n")
    return turns.select(key).distinct().join(body, key, "left").select(key, F.concat(F.lit("# "), F.col(key).cast("string"), F.coalesce(F.concat(F.lit("\n\n"), "content"), F.lit("\n"))).alias("content"))


def canonical(turns: DataFrame, header: DataFrame | None = None, key: str = "interview_id") -> DataFrame:
    """K4: (key, content): JSON of each recording with its turns in order, and the header's columns."""
    turn = F.struct("turn", F.struct((F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "speaker", "human_label", "text", "flags", "notes").alias("t"))
    grouped = turns.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("r"))
    extra = [c for c in header.columns if c != key] if header is not None else []
    joined = grouped.join(header, key, "left") if header is not None else grouped
    return joined.select(key, F.to_json(F.struct(key, *extra, F.col("r.t").alias("turns"))).alias("content"))


def raw_rows(segments: DataFrame, key: str = "interview_id") -> DataFrame:
    """(key, idx, tsv, txt, srt_times, vtt_times, cue) of raw recogniser segments, safe for each format."""
    order = Window.partitionBy(key).orderBy("idx")
    timed = segments.where("start_ms IS NOT NULL AND end_ms IS NOT NULL")
    return timed.select(
        key,
        "idx",
        F.concat_ws("\t", F.col("start_ms").cast("string"), F.col("end_ms").cast("string"), X.cell_safe(F.col("text"))).alias("tsv"),
        F.trim("text").alias("txt"),
        F.concat(timecode(F.col("start_ms"), ","), F.lit(" --> "), timecode(F.col("end_ms"), ",")).alias("srt_times"),
        F.concat(timecode(F.col("start_ms")), F.lit(" --> "), timecode(F.col("end_ms"))).alias("vtt_times"),
        F.row_number().over(order).alias("number"),
        X.cue_safe(F.col("text")).alias("cue"),
    )


def raw_files(segments: DataFrame, key: str = "interview_id") -> dict[str, DataFrame]:
    """(key, content) of SRT, WebVTT, text and tab-separated files."""
    rows = raw_rows(segments, key)
    return {
        "srt": _in_order(rows, F.concat_ws("\n", F.col("number").cast("string"), "srt_times", "cue"), "idx", key, "\n\n"),
        "vtt": _in_order(rows, F.concat_ws("\n", "vtt_times", "cue"), "idx", key, "\n\n", "WEBVTT\n\n"),
        "txt": _in_order(rows, F.col("txt"), "idx", key, "\n"),
        "tsv": _in_order(rows, F.col("tsv"), "idx", key, "\n", "start\tend\ttext\n"),
    }


def rttm(spans: DataFrame, key: str = "interview_id") -> DataFrame:
    """(key, idx, line): start and duration in seconds, by the RTTM layout."""
    line = F.concat_ws(" ", F.lit("SPEAKER"), F.col(key).cast("string"), F.lit("1"), seconds_text(F.col("start_ms")), seconds_text(F.col("end_ms") - F.col("start_ms")), F.lit("<NA> <NA>"), "speaker", F.lit("<NA> <NA>"))
    return spans.select(key, "idx", line.alias("line"))


def write_csv(df: DataFrame, path: str, columns: list[str], sep: str = ",", sort_by: list[str] | None = None, bom: bool = False) -> None:
    """K1, K8, K9: columns in a fixed order; sorted output is one range-partitioned set of part files.

    With ``bom`` the header's first cell starts with a byte order mark, as spreadsheet programs like it.
    """
    out = df.select(*columns)
    out = out.orderBy(*sort_by) if sort_by else out
    if bom:
        out = out.withColumnRenamed(columns[0], BOM + columns[0])
    out.write.mode("overwrite").csv(path, header=True, sep=sep, quote='"', escape='"', emptyValue="")


#: Rows of a table that may be written as one file.
ONE_FILE_ROWS = 1_000_000


def write_csv_file(df: DataFrame, path: str, columns: list[str], sort_by: list[str], bom: bool = True) -> None:
    """K1, O1, O2: a library table as one sorted CSV file with one header, in the folder ``path``.

    For tables with a row a recording, as other programs want them; a table beyond ``ONE_FILE_ROWS`` is an error, as one
    task writes the file.
    """
    if df.limit(ONE_FILE_ROWS + 1).count() > ONE_FILE_ROWS:
        raise ValueError(f"more than {ONE_FILE_ROWS} rows: use write_csv")
    out = df.select(*columns, *(c for c in sort_by if c not in columns)).coalesce(1).sortWithinPartitions(*sort_by).select(*columns)
    if bom:
        out = out.withColumnRenamed(columns[0], BOM + columns[0])
    out.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_json_pretty(df: DataFrame, path: str) -> None:
    """K2: one indented JSON document for each row, characters as they are."""
    df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def variant_folder(folder: str, variants: str, variant: str | None) -> str:
    """Where a recogniser variant's documents go: a folder of its own below ``variants``, or the usual one without a name."""
    if not variant:
        return folder
    safe = re.sub(r"[^A-Za-z0-9_.-]+", "_", variant).strip("._")
    if not safe:
        raise ValueError("no character of the variant's name can be part of a path")
    return f"{variants.rstrip('/')}/{safe}"


def append_log(events: DataFrame, path: str) -> None:
    """K3: events appended as JSON lines with sorted keys."""
    events.select(*sorted(events.columns)).write.mode("append").json(path)


def write_contents(files: DataFrame, path: str, key: str = "interview_id") -> None:
    """A folder for each recording with its content as text, for tables that Spark reads again."""
    files.select(key, F.regexp_replace("content", "\n$", "").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def delimited(rows: DataFrame, columns: list[str], order: str, key: str, sep: str = ",") -> DataFrame:
    """K8, K9: (key, content) of tables as text, with a byte order mark and a header, quoted where needed."""
    line = F.to_csv(F.struct(*columns), {"sep": sep, "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    grouped = rows.select(key, order, line.alias("line")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "line"))).alias("l"))
    return grouped.select(key, F.concat(F.lit(BOM + sep.join(columns) + "\r\n"), F.array_join("l.line", "\r\n"), F.lit("\r\n")).alias("content"))


def turn_tables(turns: DataFrame, key: str = "interview_id", sep: str = ",") -> DataFrame:
    """K8: (key, content) of the turns as a table."""
    keep = ("turn",) if key in TURN_COLUMNS else (key, "turn")
    return delimited(turn_rows(turns, key, keep), TURN_COLUMNS, "turn", key, sep)


def nvivo(turns: DataFrame, key: str = "interview_id") -> DataFrame:
    """K9: (key, content) of the tables for coding programs."""
    return delimited(nvivo_rows(turns, key), ["Timespan", "Speaker", "Content"], "turn", key, "\t")


def documents(turns: DataFrame, key: str = "interview_id") -> DataFrame | None:
    """(key, content) of DOCX files, as bytes; None without python-docx."""
    try:
        import docx  # noqa: F401
    except ImportError:
        LOG.info("python-docx is not installed: no documents written")
        return None
    rows = blocks(turns, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", clock(F.col("start_ms")).alias("at"), "label", "paragraphs"))).alias("b"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        from docx import Document

        for batch in batches:
            for k, (name, parts) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                document, out = Document(), io.BytesIO()
                document.add_heading(str(name), level=1)
                for block in parts:
                    first = document.add_paragraph()
                    first.add_run(f"[{block['at']}] ")
                    first.add_run(f"{block['label']}: ").bold = True
                    first.add_run(block["paragraphs"][0])
                    for text in block["paragraphs"][1:]:
                        document.add_paragraph(text)
                document.save(out)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([out.getvalue()], pa.binary())], names=[key, "content"])

    ship(turns.sparkSession)
    return rows.mapInArrow(build, f"{key} {turns.schema[key].dataType.simpleString()}, content binary")


#: Formats of an export: how a recording's file name ends, and what is in the files.
FORMATS: dict[str, tuple[str, Callable[[DataFrame, str], DataFrame | None]]] = {
    "json": (".canonical.json", lambda turns, key: canonical(turns, None, key)),
    "md": (".md", markdown),
    "srt": (".srt", srt),
    "vtt": (".vtt", vtt),
    "csv": (".csv", turn_tables),
    "tsv": (".tsv", lambda turns, key: turn_tables(turns, key, "\t")),
    "nvivo": ("_nvivo.tsv", nvivo),
    "docx": (".docx", documents),
}


def export(turns: DataFrame, folder: str, formats: tuple[str, ...] = ("md", "docx", "srt", "vtt", "csv", "tsv", "nvivo"), key: str = "interview_id", mode: str = "append") -> list[str]:
    """The turns in several formats, a file a recording in a folder a format, each folder committed as one; the formats written."""
    turns = turns.persist()
    done = []
    try:
        for name in formats:
            ending, contents = FORMATS[name]
            files = contents(turns, key)
            if files is not None:
                named.write(files, f"{folder}/{name}", ending, key, mode)
                done.append(name)
        return done
    finally:
        turns.unpersist()


def shown_files(files: DataFrame) -> DataFrame:
    """Files whose folder is one that users see."""
    return files.where(F.substring_index(F.substring_index("path", "/", -2), "/", 1).isin(*SHOWN_FOLDERS))


def settings_lines(settings: dict) -> str:
    """Settings as lines that the settings reader takes."""

    def value(x: object) -> str:
        if x is None:
            return "null"
        if isinstance(x, bool):
            return str(x).lower()
        return json.dumps(x, ensure_ascii=False) if isinstance(x, str) else str(x)

    lines = []
    for key, x in settings.items():
        lines += [f"{key}:", *(f"  - {value(v)}" for v in x)] if isinstance(x, (list, tuple)) else [f"{key}: {value(x)}"]
    return "\n".join(lines) + "\n"
