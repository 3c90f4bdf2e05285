"""Queries over stores: named files with a commit, logs that grow in place, audio files read in ranges."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import library, waveform
from ..session import ship
from ..sources import growing, named, readers, writers
from ..streaming import events as S
from . import chain as CH
from . import transcripts as TR
from .bindings import table
from .reviews import ORACLE as REVIEWS
from .streams import _folder


def export_contents(spark, d):
    """What is in the files of each format and recording, read by their names."""
    folder = _folder(spark, "export")
    formats = ("json", "md", "srt", "vtt", "csv", "tsv", "nvivo")
    writers.export(TR.all_turns(spark, d).withColumn("interview_id", F.col("conv_id")), folder, formats)
    found = None
    for name in formats:
        one = readers.named_files(spark, f"{folder}/{name}", writers.FORMATS[name][0], "conv_id").select(F.lit(name).alias("format"), F.col("conv_id").cast("bigint").alias("conv_id"), F.md5("content").alias("h"))
        found = one if found is None else found.unionByName(one)
    return found


def render_contents(spark, d):
    """K5-K7: the text files of the whole chain, from documents to contents, in every format."""
    found = None
    for name, files in CH._rendered(spark, d).files().items():
        one = files.select(F.lit(name).alias("format"), "conv_id", F.md5("content").alias("h"))
        found = one if found is None else found.unionByName(one)
    return found


def stream_growing_log(spark, d):
    """ST1, S11, K3: sixteen logs, read before and after lines are appended to them; each line with the batch that brought it."""
    line = F.to_json(F.struct("user_id", "event_id", "event_type"))
    rows = table(spark, d, "events").select((F.col("user_id") % 16).alias("log"), F.struct((F.col("event_id") % 2).alias("later"), "event_id", line.alias("line")).alias("r"))
    logs, checkpoint, out = _folder(spark, "logs"), _folder(spark, "progress"), _folder(spark, "stream")

    def save(batch, number):
        batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("append").parquet(out)

    for last in range(2):  # the files of the second turn begin with all that was in the first
        lines = rows.where(F.col("r.later") <= last).groupBy("log").agg(F.array_sort(F.collect_list("r")).alias("l"))
        named.write(lines.select("log", F.concat(F.array_join("l.line", "\n"), F.lit("\n")).alias("content")), logs, ".jsonl", "log")
        stream = growing.stream(spark, logs, "user_id bigint, event_id bigint, event_type string", partitionBytes="65536")
        S.run_available(stream.drop("path", "position"), checkpoint, "append", save).awaitTermination()
    return spark.read.parquet(out)


def wav_ranges(spark, d):
    """WAV files of one and two channels and three widths, written by name and read in ranges of a few hundred bytes."""

    @F.pandas_udf("binary")
    def wav(values: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        def one(v, w, c) -> bytes:
            data, samples = io.BytesIO(), np.asarray(v, np.int64)
            with wave.open(data, "wb") as file:
                file.setnchannels(int(c))
                file.setsampwidth(int(w))
                file.setframerate(8000)
                file.writeframes(np.repeat(samples + 128 if w == 1 else samples, c).astype({1: np.uint8, 2: "<i2", 4: "<i4"}[w]).tobytes())
            return data.getvalue()

        return pd.Series([one(*x) for x in zip(values, width, channels, strict=True)])

    ship(spark)
    k = F.col("l_suppkey")
    sample = F.struct("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)).alias("v"))
    made = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(sample)).alias("s"))
    folder = _folder(spark, "wav")
    width = F.element_at(F.array(*map(F.lit, (1, 2, 4))), (k % 3 + 1).cast("int"))
    named.write(made.select("l_suppkey", wav(F.col("s.v"), width, (k % 2 + 1).cast("int")).alias("content")), folder, ".wav", "l_suppkey")
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder).select("path", "length")
    found = waveform.file_peaks(listing, 10, range_bytes=512)
    return found.select(F.regexp_extract("file_id", r"(\d+)\.wav$", 1).cast("bigint").alias("l_suppkey"), "peak_idx", "peak", F.col("rate").cast("bigint").alias("rate"))


def waveform_lookups(spark, d):
    """The level of a stretch for every line of an order, over the peaks of its supplier."""
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("double").alias("peak"), "l_orderkey")
    peaks = lines.select("file_id", (F.row_number().over(Window.partitionBy("file_id").orderBy("id", "peak")) - 1).cast("bigint").alias("peak_idx"), "peak")
    files = peaks.groupBy("file_id").agg((F.count("*") / 4).alias("duration"))
    asked = lines.groupBy("file_id", "id").agg(F.min((F.col("l_orderkey") % 1000 / 8).cast("double")).alias("start"), F.min((F.col("l_orderkey") % 1000 / 8 + F.col("l_orderkey") % 37 / 2).cast("double")).alias("end"))
    found = waveform.levels(asked, peaks, files)
    return found.select("file_id", "id", F.round("level", 6).alias("level"))


def tagged_jobs(spark, d):
    """X2, ST4: a job for each kind of event that writes its events' table, one of them cancelled; outcomes and what was written."""
    kinds = [r[0] for r in table(spark, d, "events").select("event_type").distinct().orderBy("event_type").limit(100).collect()]  # a fixed set of kinds
    base = _folder(spark, "kinds")

    def job(kind):
        return lambda: table(spark, d, "events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("n")).write.parquet(f"{base}/event_type={kind}")

    done = S.run_tagged(spark, {k: job(k) for k in kinds}, lambda kind: kind == "click")
    outcomes = spark.createDataFrame(list(done.items()), "event_type string, status string")
    written = spark.read.schema("user_id bigint, n bigint, event_type string").parquet(base).groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("users"))
    return outcomes.join(written, "event_type", "left")


def folded_options(spark, d):
    """Labels that differ by case only, by Unicode's rules, meet once."""
    labels = table(spark, d, "nation").selectExpr("concat(n_name, ' Straße') AS label", "n_nationkey AS idx")
    seen = table(spark, d, "customer").selectExpr("CASE c_custkey % 3 WHEN 0 THEN concat(' ', upper(c_mktsegment), ' ΣΑΣ') WHEN 1 THEN concat(lower(c_mktsegment), ' σας ') ELSE concat(lower(c_mktsegment), ' STRASSE') END AS label", "c_custkey AS idx").unionByName(table(spark, d, "nation").selectExpr("concat(lower(n_name), ' STRASSE') AS label", "-1 - n_nationkey AS idx"))
    return library.speaker_options(labels, seen).select("label", F.col("prio").cast("bigint").alias("prio"), F.col("idx").cast("bigint").alias("idx"))


QUERIES = {f.__name__: f for f in (export_contents, render_contents, stream_growing_log, wav_ranges, waveform_lookups, tagged_jobs, folded_options)}


def _cell(column: str, sep: str) -> str:
    return f"""CASE WHEN regexp_matches("{column}", '[{sep}"\n\r]') THEN '"' || replace("{column}", '"', '""') || '"' ELSE "{column}" END"""


def _table_sql(source: str, columns: list[str], sep: str, order: str) -> str:
    """(conv_id, content) of delimited files from a query with the columns, conv_id and the order."""
    cells = f" || '{sep}' || ".join(_cell(c, sep) for c in columns)
    return f"SELECT conv_id, chr(65279) || '{sep.join(columns)}' || chr(13) || chr(10) || string_agg({cells} || chr(13) || chr(10), '' ORDER BY {order}) AS content FROM ({source}) GROUP BY conv_id"


_TURN_ROWS = f"SELECT *, CAST(interview_id AS bigint) AS conv_id FROM ({TR.ORACLE['turns_csv_rows']})"
_CONTENTS = {
    "json": REVIEWS["canonical_json"].replace('"conv_id":', '"interview_id":'),
    "md": REVIEWS["markdown_files"],
    "srt": TR.ORACLE["srt_files"],
    "vtt": f"{TR._TURNS}, {TR._cues('.')} SELECT conv_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(times || chr(10) || text, chr(10) || chr(10) ORDER BY cue) || chr(10) AS content FROM cues GROUP BY conv_id",
    "csv": _table_sql(_TURN_ROWS, writers.TURN_COLUMNS, ",", "turn_id"),
    "tsv": _table_sql(_TURN_ROWS, writers.TURN_COLUMNS, "\t", "turn_id"),
    "nvivo": _table_sql(TR.ORACLE["nvivo_rows"], ["Timespan", "Speaker", "Content"], "\t", "turn"),
}
_CHAIN_CONTENTS = {
    "md": REVIEWS["markdown_files"].replace(TR._TURNS, CH._CHAIN),
    "srt": f"{CH._CHAIN}, {TR._cues(',')} SELECT conv_id, string_agg(cue || chr(10) || times || chr(10) || text, chr(10) || chr(10) ORDER BY cue) || chr(10) AS content FROM cues GROUP BY conv_id",
    "vtt": f"{CH._CHAIN}, {TR._cues('.')} SELECT conv_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(times || chr(10) || text, chr(10) || chr(10) ORDER BY cue) || chr(10) AS content FROM cues GROUP BY conv_id",
}
ORACLE = {
    "render_contents": " UNION ALL ".join(f"SELECT '{name}' AS format, conv_id, md5(content) AS h FROM ({sql})" for name, sql in _CHAIN_CONTENTS.items()),
    "export_contents": " UNION ALL ".join(f"SELECT '{name}' AS format, conv_id, md5(content) AS h FROM ({sql})" for name, sql in _CONTENTS.items()),
    "wav_ranges": """WITH v AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, CAST(l_quantity AS int) * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) - 1 AS i, abs(CAST(l_quantity AS int)) AS v FROM lineitem),
      t AS (SELECT l_suppkey, i // 10 AS peak_idx, max(v) AS top FROM v GROUP BY ALL) SELECT l_suppkey, peak_idx, top::double / greatest(max(top) OVER (PARTITION BY l_suppkey), 1)::double AS peak, 8000 AS rate FROM t""",
    "waveform_lookups": """WITH p AS (SELECT l_suppkey AS f, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 8 + l_linenumber, l_quantity) - 1 AS i, CAST(l_quantity AS double) AS v FROM lineitem),
      n AS (SELECT f, count(*) AS n, count(*) / 4.0::double AS dur FROM p GROUP BY f),
      q AS (SELECT l_suppkey AS f, l_orderkey * 8 + l_linenumber AS id, min(l_orderkey % 1000 / 8.0::double) AS a, min(l_orderkey % 1000 / 8.0::double + l_orderkey % 37 / 2.0::double) AS b FROM lineitem GROUP BY ALL),
      s AS (SELECT q.*, n, greatest(a, 0) / dur * n AS x, least(dur, b) / dur * n AS y FROM q JOIN n USING (f)),
      r AS (SELECT *, greatest(0, least(n - 1, CAST(trunc(x) AS bigint))) AS i0 FROM s), e AS (SELECT *, greatest(i0 + 1, least(n, CAST(trunc(y) AS bigint) + 1)) AS i1 FROM r),
      long AS (SELECT e.f, id, max(v) AS level FROM e JOIN p ON p.f = e.f AND p.i >= i0 AND p.i < i1 WHERE i1 - i0 > 2 GROUP BY ALL),
      near AS (SELECT e.f, id, l.v + (r.v - l.v) * greatest(0, least(1, x - i0)) AS level FROM e JOIN p l ON l.f = e.f AND l.i = i0 JOIN p r ON r.f = e.f AND r.i = least(n - 1, i0 + 1) WHERE i1 - i0 <= 2)
      SELECT f AS file_id, id, round(level, 6) AS level FROM (SELECT * FROM long UNION ALL SELECT * FROM near)""",
    "tagged_jobs": "SELECT event_type, CASE WHEN event_type = 'click' THEN 'cancelled' ELSE 'ok' END AS status, CASE WHEN event_type != 'click' THEN count(*) END AS n, CASE WHEN event_type != 'click' THEN count(DISTINCT user_id) END AS users FROM events GROUP BY event_type",
    "folded_options": """WITH e AS (SELECT n_name || ' Straße' AS label, 0 AS prio, n_nationkey AS idx, upper(n_name) || ' STRASSE' AS f FROM nation
      UNION ALL SELECT CASE c_custkey % 3 WHEN 0 THEN ' ' || upper(c_mktsegment) || ' ΣΑΣ' WHEN 1 THEN lower(c_mktsegment) || ' σας ' ELSE lower(c_mktsegment) || ' STRASSE' END, 1, c_custkey, upper(c_mktsegment) || CASE WHEN c_custkey % 3 = 2 THEN ' STRASSE' ELSE ' ΣΑΣ' END FROM customer
      UNION ALL SELECT lower(n_name) || ' STRASSE', 1, -1 - n_nationkey, upper(n_name) || ' STRASSE' FROM nation)
      SELECT label, prio, idx FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY prio, idx) AS nth FROM e) WHERE nth = 1""",
    "stream_growing_log": "SELECT user_id, event_id, event_type, event_id % 2 AS batch FROM events",
}
