"""Queries over files: finding documents, spans and words in JSON, hashes, removal, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import media as M
from ..operators import models, trash
from ..sources import readers, writers
from .bindings import table
from .transcripts import all_turns

# Paths of raw documents; one text for both engines.
_PATHS = """
  SELECT c_custkey, concat('/asr/', CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'json/' WHEN 2 THEN 'json/' ELSE 'srt/' END, 'C', CAST(c_custkey % 400 AS string), CASE c_custkey % 4 WHEN 2 THEN '.whisperx.json' WHEN 3 THEN '.srt' ELSE '.json' END) AS path
  FROM {0}"""


def _paths(spark, d):
    return spark.sql(_PATHS.format("{t}"), t=table(spark, d, "customer"))


def find_documents(spark, d):
    ids = table(spark, d, "customer").selectExpr("concat('C', c_custkey) AS interview_id").where("interview_id != 'C7'")
    return readers.find_documents(_paths(spark, d).select("path").distinct(), ids)


def spans_json(spark, d):
    docs = table(spark, d, "supplier").selectExpr("CAST(s_suppkey AS string) AS interview_id", """concat('{"segments": [1, {"start": ', s_suppkey, '.25, "end": ', CASE WHEN s_suppkey % 3 = 0 THEN 'null' ELSE CAST(s_suppkey + 2 AS string) END, ', "speaker": "A"}, "x", {"end": 2}]}') AS document""")
    return readers.spans(docs).select("interview_id", F.col("idx").cast("bigint").alias("idx"), "start_ms", "end_ms", "speaker")


def words_json(spark, d):
    docs = table(spark, d, "supplier").selectExpr(
        "CAST(s_suppkey AS string) AS interview_id",
        """concat('{"segments": [{"start": 0, "end": 9, "text": "t", "words": ["w", {"word": " a', s_suppkey, ' ", "start": 1, "end": ', s_suppkey % 4, '.5, "probability": 0.25}, {"text": "b", "start": "2", "end": 3}, {"word": "c", "start": "z", "end": 3}]}]}') AS document""",
    )
    return readers.asr_words(readers.asr_segments(docs)).select("interview_id", F.col("widx").cast("bigint").alias("widx"), "start_ms", "end_ms", "word", "score")


def file_hashes(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", M.file_hash(F.col("text").cast("binary")).alias("sha256"))


def shown_files(spark, d):
    files = table(spark, d, "nation").selectExpr("n_nationkey", "concat('/out/', element_at(array('md', 'raw', 'srt', 'csv', 'tmp'), CAST(n_regionkey + 1 AS int)), '/', n_name) AS path")
    return writers.shown_files(files)


def outputs_of_recordings(spark, d):
    ids = table(spark, d, "customer").where("c_custkey % 5 = 0").selectExpr("concat('C', c_custkey % 40) AS id").distinct()
    return trash.outputs_of(_paths(spark, d), ids).select("c_custkey", "path")


def trash_states(spark, d):
    entries = table(spark, d, "customer").selectExpr("c_custkey AS trash_id", "element_at(array('moving', 'trashed', 'restored', 'purged'), CAST(c_custkey % 4 + 1 AS int)) AS status")
    actions = table(spark, d, "customer").where("c_custkey % 7 != 0").selectExpr("c_custkey AS trash_id", "element_at(array('finalize', 'restore', 'redo', 'purge'), CAST(c_custkey % 5 % 4 + 1 AS int)) AS action")
    return trash.advance(entries, actions)


def model_resolve(spark, d):
    registry = table(spark, d, "nation").selectExpr("lower(n_name) AS name", "concat('own/', n_nationkey) AS repo", "array(concat('m', n_nationkey)) AS aliases")
    asked = table(spark, d, "supplier").selectExpr("s_suppkey", "CASE s_suppkey % 3 WHEN 0 THEN concat('m', s_suppkey % 40) WHEN 1 THEN '/models/x' ELSE 'remote/y' END AS model")
    return models.resolve(asked, registry)


def speaker_arguments(spark, d):
    rows = table(spark, d, "supplier").selectExpr("s_suppkey", "CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 5 AS int) END AS n", "CAST(1 AS int) AS lo", "CASE WHEN s_suppkey % 2 = 0 THEN CAST(4 AS int) END AS hi")
    s = rows.select("s_suppkey", M.speaker_arguments(F.col("n"), F.col("lo"), F.col("hi")).alias("s"))
    return s.select("s_suppkey", *(F.col(f"s.{c}").cast("bigint").alias(c) for c in ("num_speakers", "min_speakers", "max_speakers")))


def canonical_json(spark, d):
    return writers.canonical(all_turns(spark, d), None, "conv_id")


def raw_tsv_files(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn AS idx", "turn * 1000 AS start_ms", "turn * 1000 + 500 AS end_ms", "text")
    return writers.raw_files(rows, "conv_id")["tsv"]


QUERIES = {f.__name__: f for f in (find_documents, spans_json, words_json, file_hashes, shown_files, outputs_of_recordings, trash_states, model_resolve, speaker_arguments, canonical_json, raw_tsv_files)}

_P = "p AS (" + _PATHS.format("customer").replace("AS string", "AS varchar") + ")"
ORACLE = {
    "find_documents": rf"""WITH {_P}, f AS (SELECT DISTINCT path FROM p), c AS (
        SELECT regexp_extract(path, '([^/]*)\.json$', 1) AS id, path, 0 AS r FROM f WHERE path LIKE '%.json'
        UNION ALL SELECT regexp_extract(path, '([^/]*)\.json$', 1), path, 1 FROM f WHERE path LIKE '%/json/%.json'
        UNION ALL SELECT regexp_extract(path, '([^/]*)\.whisperx\.json$', 1), path, 2 FROM f WHERE path LIKE '%/json/%.whisperx.json')
      SELECT id AS interview_id, arg_min(path, r || path) AS path FROM c WHERE id != 'C7' AND id IN (SELECT 'C' || c_custkey FROM customer) GROUP BY id""",
    "spans_json": """SELECT CAST(s_suppkey AS varchar) AS interview_id, 1 AS idx, s_suppkey * 1000 + 250 AS start_ms, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 1000 + 250 ELSE (s_suppkey + 2) * 1000 END AS end_ms, 'A' AS speaker FROM supplier
      UNION ALL SELECT CAST(s_suppkey AS varchar), 3, 0, 2000, '' FROM supplier""",
    "words_json": """SELECT CAST(s_suppkey AS varchar) AS interview_id, 1 AS widx, 1000 AS start_ms, CAST((s_suppkey % 4) * 1000 + 500 AS bigint) AS end_ms, 'a' || s_suppkey AS word, 0.25::double AS score FROM supplier WHERE s_suppkey % 4 > 0
      UNION ALL SELECT CAST(s_suppkey AS varchar), 2, 2000, 3000, 'b', NULL FROM supplier""",
    "file_hashes": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL",
    "shown_files": "SELECT n_nationkey, '/out/' || ['md', 'raw', 'srt', 'csv', 'tmp'][n_regionkey + 1] || '/' || n_name AS path FROM nation WHERE n_regionkey IN (0, 2, 3)",
    "outputs_of_recordings": rf"WITH {_P} SELECT c_custkey, path FROM p WHERE regexp_extract(path, '([^/.]*)\.[^/]*$', 1) IN (SELECT 'C' || (c_custkey % 40) FROM customer WHERE c_custkey % 5 = 0)",
    "trash_states": """WITH e AS (SELECT c_custkey AS trash_id, ['moving', 'trashed', 'restored', 'purged'][c_custkey % 4 + 1] AS s, CASE WHEN c_custkey % 7 != 0 THEN ['finalize', 'restore', 'redo', 'purge'][c_custkey % 5 % 4 + 1] END AS a FROM customer)
      SELECT trash_id, CASE WHEN s = 'moving' AND a = 'finalize' THEN 'trashed' WHEN s = 'trashed' AND a = 'restore' THEN 'restored' WHEN s = 'restored' AND a = 'redo' THEN 'trashed' WHEN s = 'trashed' AND a = 'purge' THEN 'purged' ELSE s END AS status FROM e""",
    "model_resolve": """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'm' || (s_suppkey % 40) WHEN 1 THEN '/models/x' ELSE 'remote/y' END AS model,
      CASE s_suppkey % 3 WHEN 0 THEN CASE WHEN s_suppkey % 40 IN (SELECT n_nationkey FROM nation) THEN 'own/' || (s_suppkey % 40) END WHEN 1 THEN '/models/x' END AS repo FROM supplier""",
    "speaker_arguments": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 5 END AS num_speakers, CASE WHEN s_suppkey % 3 != 0 THEN 1 END AS min_speakers, CASE WHEN s_suppkey % 3 != 0 AND s_suppkey % 2 = 0 THEN 4 END AS max_speakers FROM supplier",
    "raw_tsv_files": r"""SELECT conv_id, rtrim('start' || chr(9) || 'end' || chr(9) || 'text' || chr(10) || string_agg(turn * 1000 || chr(9) || (turn * 1000 + 500) || chr(9) || trim(regexp_replace(text, '[\t\r\n]', ' ', 'g')), chr(10) ORDER BY turn)) || chr(10) AS content FROM conversations GROUP BY conv_id""",
}
