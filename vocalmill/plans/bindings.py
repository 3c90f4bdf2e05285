"""The driver's tables as recordings: segments, spans and words with whole-millisecond times, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse

LABELS = ("Entrevistador", "Entrevistado")

# One text for both engines; {0} is the conversations table.
SEGMENTS_SQL = """
  SELECT conv_id, turn AS idx, CASE WHEN turn % 7 < 5 THEN 'SPEAKER_00' ELSE 'SPEAKER_01' END AS speaker,
         CASE WHEN turn % 7 < 5 THEN 'ENTREVISTADOR' WHEN conv_id % 3 = 0 THEN '' ELSE ' Maria  Silva ' END AS human_label,
         st AS start_ms, st + dur AS end_ms, text, turn % 6 = 0 AS needs_review
  FROM (SELECT conv_id, turn, text, CAST(length(text) AS bigint) * 60 AS dur,
               CAST(coalesce(sum(CAST(length(text) AS bigint) * 60 + (turn * turn * 7919 % 2400))
                    OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS st
        FROM {0}) q"""
SPANS_SQL = """
  SELECT conv_id, idx, CASE WHEN idx % 3 = 0 THEN 'SPEAKER_01' ELSE 'SPEAKER_00' END AS speaker,
         start_ms + CAST(floor((end_ms - start_ms) * 0.375) AS bigint) AS start_ms, end_ms + CAST(floor((end_ms - start_ms) * 0.25) AS bigint) AS end_ms
  FROM {0}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SEGMENTS_SQL.format("{conversations}"), conversations=table(spark, sf_dir, "conversations"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPANS_SQL.format("{seg}"), seg=segments(spark, sf_dir))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the segments, spread evenly over their time."""
    rows = segments(spark, sf_dir).withColumn("w", F.split(collapse(F.col("text")), " ")).withColumn("n", F.size("w")).withColumn("dur", F.col("end_ms") - F.col("start_ms"))
    each = rows.select("conv_id", "idx", F.col("start_ms").alias("s"), "dur", "n", F.posexplode("w").alias("widx", "word"))
    return each.selectExpr("conv_id", "idx", "CAST(widx AS bigint) AS widx", "s + dur * widx div n AS start_ms", "s + dur * (widx + 1) div n AS end_ms", "word", "(widx % 10) / 10.0D AS score").where("word != ''")


def event_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals in whole seconds: (event_id, user_id, event_type, start_s, dur_s)."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("start_s"), F.floor("value").cast("bigint").alias("dur_s"))


COLLAPSE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
SEG = f"seg AS ({SEGMENTS_SQL.format('conversations')})"
SPAN = f"span AS ({SPANS_SQL.format('seg')})"
WORD = f"""word AS (
  SELECT conv_id, idx, CAST(widx AS bigint) AS widx, start_ms + dur * widx // n AS start_ms, start_ms + dur * (widx + 1) // n AS end_ms, w[widx + 1] AS word, (widx % 10) / 10.0::double AS score
  FROM (SELECT conv_id, idx, start_ms, end_ms - start_ms AS dur, w, len(w) AS n, unnest(range(len(w))) AS widx
        FROM (SELECT conv_id, idx, start_ms, end_ms, string_split({COLLAPSE.format('text')}, ' ') AS w FROM seg)) WHERE w[widx + 1] != '')"""
EVENT = "ev AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS bigint) AS start_s, CAST(floor(value) AS bigint) AS dur_s FROM events)"


def turns_sql(gap: int = 1800, cap: int = 90000) -> str:
    """Common table expressions that end in ``turns``, for use after WITH RECURSIVE."""
    join = f"s.speaker = w.speaker AND s.start_ms - w.prev_end <= {gap} AND s.end_ms - w.t0 <= {cap}"
    return f"""{SEG},
s AS (SELECT *, {COLLAPSE.format('text')} AS body, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS rn FROM seg WHERE {COLLAPSE.format('text')} != ''),
walk AS (
  SELECT conv_id, rn, speaker, start_ms AS t0, end_ms AS prev_end, 0 AS turn FROM s WHERE rn = 1
  UNION ALL
  SELECT s.conv_id, s.rn, s.speaker, CASE WHEN {join} THEN w.t0 ELSE s.start_ms END, s.end_ms, CASE WHEN {join} THEN w.turn ELSE w.turn + 1 END
  FROM walk w JOIN s ON s.conv_id = w.conv_id AND s.rn = w.rn + 1),
turns AS (
  SELECT s.conv_id, CAST(w.turn AS bigint) AS turn, min_by(s.start_ms, s.rn) AS start_ms, max_by(s.end_ms, s.rn) AS end_ms, min(s.speaker) AS speaker, min(s.human_label) AS human_label,
    string_agg(s.body, ' ' ORDER BY s.rn) AS text, count(*) AS segments, CASE WHEN min_by(s.needs_review, s.rn) THEN 'duvida' ELSE '' END AS flags
  FROM walk w JOIN s USING (conv_id, rn) GROUP BY s.conv_id, w.turn)"""
