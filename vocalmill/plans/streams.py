"""Queries that need streams, Python folds or written files; most have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review
from ..shared import folder as _folder
from ..sources import readers
from ..streaming import events as S
from .bindings import table
from .transcripts import all_turns


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.selectExpr("user_id AS file_id", "event_id AS seq", "event_type AS status", "CAST(floor(value) AS bigint) % 120 AS progress", "ts AS updated_at")


def _collected(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there, append what it emits to a written table, and read that."""
    out = _folder(spark, "stream")

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    S.run_available(stream, _folder(spark, "progress"), mode, save).awaitTermination()
    return spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(out)


def stream_latest_state(spark, d):
    """ST1, ST2: the last event of each user, from the stream's last update."""
    stream = _event_stream(spark, d).selectExpr("file_id", "struct(updated_at, seq) AS at", "seq", "status", "progress")
    found = _collected(spark, S.latest_state(stream, "file_id", "at").select("file_id", "seq", "status", "progress"), "update")
    last = found.groupBy("file_id").agg(F.max_by(F.struct("seq", "status", "progress"), "batch").alias("e"))
    return last.select("file_id", "e.*")


def stream_held_progress(spark, d):
    """ST3: progress that never falls."""
    found = _collected(spark, S.held_progress(_event_stream(spark, d), cap=90), "append")
    return found.select(F.col("file_id").cast("bigint").alias("file_id"), "seq", "shown")


def review_replay(spark, d):
    """Turns after a log of edits of every kind."""
    turns = review.normalize(all_turns(spark, d).withColumn("interview_id", F.col("conv_id").cast("string")))
    numbered = turns.select("interview_id", F.col("pos").cast("bigint").alias("seq"), "turn_id", "start_ms", "end_ms")
    action = F.element_at(F.array(*map(F.lit, ("set_text", "set_speaker", "set_times", "toggle_flag", "set_flags", "merge_next", "split", "move_boundary"))), (F.pmod(F.col("seq") + F.length("interview_id"), F.lit(8)) + 1).cast("int"))
    text = lambda c: c.cast("string")
    payload = F.create_map(
        F.lit("text"), F.concat(F.lit(" new text "), text(F.col("seq"))), F.lit("human_label"), F.lit("Ana"), F.lit("start_ms"), text(F.col("start_ms") + 10), F.lit("end_ms"), text(F.col("end_ms") + 10),
        F.lit("flag"), F.lit("inaudivel"), F.lit("flags"), F.lit("b| a |b"), F.lit("edge"), F.lit("end"), F.lit("at_ms"), text(F.col("end_ms") - 5),
    )
    edits = numbered.select("interview_id", "seq", action.alias("action"), "turn_id", payload.alias("payload"))
    return review.replay(turns, edits).withColumn("flags", F.array_join("flags", ";"))


def _asr_documents(spark, d):
    """Conversations as recogniser output, with malformed parts."""
    seg = table(spark, d, "conversations").selectExpr("conv_id", "turn", "text")
    good = F.to_json(F.struct((F.col("turn") * 2.5).alias("start"), (F.col("turn") * 2.5 + F.when(F.col("turn") % 3 == 1, -1).otherwise(2)).alias("end"), "text", F.when(F.col("turn") % 4 == 0, F.lit("SPEAKER_01")).alias("speaker")))
    odd = F.element_at(F.array(*map(F.lit, ("null", "7", '"text"', '{"start": NaN, "end": 3, "text": "x"}', '{"start": "a", "end": 3, "text": "x"}', '{"start": 1, "end": 2, "text": "  "}'))), (F.col("turn") % 6 + 1).cast("int"))
    rows = seg.select("conv_id", F.struct("turn", F.array(good, odd).alias("j")).alias("r")).groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return rows.select("conv_id", F.concat(F.lit('{"language": "pt", "segments": ['), F.array_join(F.flatten("r.j"), ", "), F.lit("]}")).alias("document"))


def lenient_json(spark, d):
    """What is left of the malformed documents."""
    s = readers.asr_segments(_asr_documents(spark, d), "conv_id")
    return s.select("conv_id", F.col("idx").cast("bigint").alias("idx"), "start_ms", "end_ms", "speaker", "text")


def probe_json(spark, d):
    """Technical columns of probe documents."""
    docs = table(spark, d, "supplier").selectExpr(
        "s_suppkey",
        """CASE WHEN s_suppkey % 10 = 0 THEN 'broken' ELSE concat('{"streams": [{"codec_type": "video", "codec_name": "h264", "width": ', s_suppkey, ', "avg_frame_rate": "', CASE WHEN s_suppkey % 2 = 0 THEN '25/1' ELSE '0/0' END,
           '"}, {"codec_type": "audio", "codec_name": "aac", "channels": 2}, {"codec_type": "audio", "codec_name": "mp3"}], "format": {"duration": "', s_suppkey, '.5", "format_name": "mov"}}') END AS document""",
    )
    p = readers.probe_metadata(docs, "s_suppkey")
    return p.select("s_suppkey", "duration_sec", "source_audio_streams", "source_audio_codec", "source_audio_channels", "source_video_width", "source_video_frame_rate", "source_format_name", "probe_status")


QUERIES = {f.__name__: f for f in (stream_latest_state, stream_held_progress, review_replay, lenient_json, probe_json)}
ORACLE = {
    "stream_latest_state": "SELECT user_id AS file_id, event_id AS seq, event_type AS status, CAST(floor(value) AS bigint) % 120 AS progress FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1",
    "stream_held_progress": "SELECT user_id AS file_id, event_id AS seq, CAST(least(max(CAST(floor(value) AS bigint) % 120) OVER (PARTITION BY user_id ORDER BY event_id), 90) AS bigint) AS shown FROM events",
    "lenient_json": r"""SELECT conv_id, 2 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS idx, CAST(turn * 2500 - CASE WHEN turn % 3 = 1 THEN 1000 ELSE 0 END AS bigint) AS start_ms, CAST(turn * 2500 + CASE WHEN turn % 3 = 1 THEN 0 ELSE 2000 END AS bigint) AS end_ms,
      CASE WHEN turn % 4 = 0 THEN 'SPEAKER_01' END AS speaker, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations""",
    "probe_json": """SELECT s_suppkey, CASE WHEN ok THEN s_suppkey || '.500' ELSE '' END AS duration_sec, CASE WHEN ok THEN '2' ELSE '0' END AS source_audio_streams, CASE WHEN ok THEN 'aac' ELSE '' END AS source_audio_codec, CASE WHEN ok THEN '2' ELSE '' END AS source_audio_channels,
      CASE WHEN ok THEN CAST(s_suppkey AS varchar) ELSE '' END AS source_video_width, CASE WHEN ok AND s_suppkey % 2 = 0 THEN '25.000' ELSE '' END AS source_video_frame_rate, CASE WHEN ok THEN 'mov' ELSE '' END AS source_format_name, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS probe_status
      FROM (SELECT s_suppkey, s_suppkey % 10 != 0 AS ok FROM supplier)""",
}
