"""Queries over recordings: turns, attribution, blocks, exports, quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import folds, intervals, qc, turns
from ..sources import writers
from . import bindings as B

KEY = "conv_id"


def _long(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def all_turns(spark: SparkSession, d: str, cap: int = 90000) -> DataFrame:
    return folds.turn_fold(B.segments(spark, d), KEY, 1800, cap)


def turn_fold(spark, d, cap: int = 90000):
    t = all_turns(spark, d, cap)
    return t.select(KEY, "turn", "start_ms", "end_ms", "speaker", "human_label", "text", *_long("segments"), F.array_join("flags", ";").alias("flags"))


def turn_fold_short_cap(spark, d):
    return turn_fold(spark, d, 40000)


def turn_fold_keep_flags(spark, d):
    t = folds.turn_fold(B.segments(spark, d), KEY, 1800, 90000, keep_flags=True)
    return t.select(KEY, "turn", F.array_join("flags", ";").alias("flags"), "notes")


def _recordings(spark, d):
    """Recordings with a duration (none for some), and some that have no turns."""
    seg = B.segments(spark, d)
    known = seg.groupBy(KEY).agg(F.max("end_ms").alias("e")).selectExpr(KEY, "CASE WHEN conv_id % 7 != 0 THEN e + conv_id % 4 * 4000 END AS duration_ms")
    return known.unionByName(known.where("conv_id % 10 = 0").selectExpr("conv_id + 1000000 AS conv_id", "duration_ms"))


def qc_metrics(spark, d):
    return qc.metrics(all_turns(spark, d), _recordings(spark, d), KEY, 30000)


def qc_notes(spark, d):
    return qc.metrics(all_turns(spark, d), _recordings(spark, d), KEY, 30000, (1, 1)).select(KEY, "notes")


def _event_turns(spark, d):
    """Events of a user as turns in order of id: their times go back and forth."""
    return B.event_intervals(spark, d).selectExpr("user_id", "event_id AS turn", "start_s * 1000 AS start_ms", "(start_s + dur_s) * 1000 AS end_ms", "CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS speaker", "'' AS human_label", "event_type AS text")


def turn_gaps_and_regressions(spark, d):
    m = qc.turn_metrics(_event_turns(spark, d), "user_id", 60000)
    return m.select("user_id", "turn_count", "speaker_count", "long_turns", "unknown_speakers", "last_ms", "max_gap_ms", "timestamp_regressions")


def speaker_time_ratio(spark, d):
    return qc.speaker_time(_event_turns(spark, d), "user_id").select("user_id", "top_ms", "total_ms")


def raw_metrics(spark, d):
    seg = B.segments(spark, d).withColumn("speaker", F.expr("CASE WHEN idx % 4 = 3 THEN '' ELSE speaker END")).withColumn("avg_logprob", F.expr("CASE WHEN idx % 3 != 0 THEN -1.0D * idx / 8 END"))
    m = qc.raw_metrics(seg, B.words(spark, d), KEY)
    return m.select(KEY, "raw_segment_count", "raw_segments_without_speaker", F.round("raw_avg_logprob_mean", 6).alias("raw_avg_logprob_mean"), "raw_word_count", F.round("raw_word_score_mean", 6).alias("raw_word_score_mean"))


def best_overlap_speaker(spark, d):
    return intervals.best_overlap(B.words(spark, d), B.spans(spark, d), ["idx", "widx"], KEY, 60000).select(KEY, "idx", "widx", "best_speaker", "overlap_ms")


def overlapping_speakers(spark, d):
    return intervals.best_overlap(B.segments(spark, d), B.spans(spark, d), ["idx"], KEY, 60000).select(KEY, "idx", "n_speakers")


def best_overlap_events(spark, d):
    ev = B.event_intervals(spark, d)
    clicks = ev.where("event_type = 'click'").selectExpr("user_id", "event_id AS idx", "start_s * 1000 AS start_ms", "(start_s + 500 * dur_s) * 1000 AS end_ms", "concat('u', event_id % 5) AS speaker")
    others = ev.where("event_type != 'click'").selectExpr("user_id", "event_id AS idx", "start_s * 1000 AS start_ms", "(start_s + 500 * dur_s) * 1000 AS end_ms")
    return intervals.best_overlap(others, clicks, ["idx"], "user_id", 86_400_000).select("user_id", F.col("idx").alias("event_id"), "best_speaker", "overlap_ms")


def attributed_segments(spark, d):
    a = turns.attribute(B.segments(spark, d).drop("needs_review"), B.words(spark, d), B.spans(spark, d), KEY)
    return a.select(KEY, "idx", *_long("sub"), "start_ms", "end_ms", "speaker", X.collapse(F.col("text")).alias("text"), *_long("words"), "split", "needs_review")


def span_merge_collar(spark, d):
    ev = B.event_intervals(spark, d).selectExpr("user_id", "event_type", "start_s * 1000 AS start_ms", "(start_s + dur_s) * 1000 AS end_ms")
    return intervals.merge_spans(ev, ["user_id", "event_type"], 3_600_000, 5000)


def speaker_rank(spark, d):
    seg = B.segments(spark, d).withColumn("speaker", F.expr("CASE idx % 4 WHEN 0 THEN 'SPEAKER_10' WHEN 1 THEN 'SPEAKER_9' WHEN 2 THEN 'Ana' ELSE '' END"))
    return turns.speaker_ranks(seg, KEY).select(KEY, "speaker", *_long("rank"))


def speaker_label_join(spark, d):
    seg = B.segments(spark, d)
    manual = seg.where("conv_id % 5 = 0").selectExpr("conv_id", "idx", "speaker AS speaker_label", "CASE WHEN idx % 2 = 0 THEN '' ELSE concat('P', idx) END AS human_label")
    return turns.speaker_labels(seg, list(B.LABELS), manual, KEY)


def readable_blocks(spark, d):
    b = turns.blocks(all_turns(spark, d), KEY)
    return b.select(KEY, *_long("block"), "start_ms", "end_ms", "speaker", "label", F.array_join("paragraphs", " ").alias("text"))


def paragraph_fold(spark, d):
    docs = folds.paragraphs(B.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array("text").alias("texts")))
    return folds.exploded(docs, ["doc_id"], "paragraphs", "nth", "paragraph")


def srt_cues(spark, d):
    return writers.cues(all_turns(spark, d), ",", KEY).select(KEY, *_long("cue"), "times", "text")


def vtt_cues(spark, d):
    return writers.cues(all_turns(spark, d), ".", KEY).select(KEY, *_long("cue"), "times", "text")


def srt_files(spark, d):
    return writers.srt(all_turns(spark, d), KEY)


def markdown_files(spark, d):
    return writers.markdown(all_turns(spark, d), KEY)


def nvivo_rows(spark, d):
    return writers.nvivo_rows(all_turns(spark, d), KEY)


def turns_csv_rows(spark, d):
    return writers.turn_rows(all_turns(spark, d), KEY)


def raw_asr_rows(spark, d):
    return writers.raw_rows(B.segments(spark, d), KEY).select(KEY, "idx", "tsv", "srt_times", "cue")


def rttm_lines(spark, d):
    return writers.rttm(B.spans(spark, d), KEY)


def stab_lookup(spark, d):
    t = all_turns(spark, d)
    points = t.groupBy(KEY).agg(F.max("end_ms").alias("e")).select(KEY, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("e"), F.lit(7000).cast("bigint"))).alias("at_ms"))
    return intervals.stab(points, t, KEY, "at_ms", 60000)


QUERIES = {f.__name__: f for f in (
    turn_fold, turn_fold_short_cap, turn_fold_keep_flags, qc_metrics, qc_notes, turn_gaps_and_regressions, speaker_time_ratio, raw_metrics, best_overlap_speaker, overlapping_speakers, best_overlap_events, attributed_segments,
    span_merge_collar, speaker_rank, speaker_label_join, readable_blocks, paragraph_fold, srt_cues, vtt_cues, srt_files, markdown_files, nvivo_rows, turns_csv_rows, raw_asr_rows, rttm_lines, stab_lookup,
)}

_TURNS = f"WITH RECURSIVE {B.turns_sql()}"
_CLOCK = "printf('%02d:%02d:%02d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60)"


def _code(ms: str, mark: str = ".") -> str:
    return f"{_CLOCK.format(ms)} || '{mark}' || printf('%03d', {ms} % 1000)"


_FLAGS = "CASE WHEN flags = 'duvida' THEN '[Dúvida]' ELSE '' END"
_LABEL_OF = "CASE WHEN trim(human_label) = '' THEN speaker WHEN human_label = 'ENTREVISTADOR' THEN 'Entrevistador' ELSE " + B.COLLAPSE.format("human_label") + " END"
_CUE_LABEL = _LABEL_OF
_END = "CASE WHEN end_ms <= start_ms THEN start_ms + 250 ELSE end_ms END"
_BODY = f"trim(text || ' ' || {_FLAGS})"
_CUES = "cues AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS cue, {code_a} || ' --> ' || {code_b} AS times, " + f"{_CUE_LABEL} || ': ' || {_BODY} AS text FROM turns)"


def _cues(mark: str) -> str:
    return _CUES.format(code_a=_code("start_ms", mark), code_b=_code(f"({_END})", mark))


_REC = "known AS (SELECT conv_id, CASE WHEN conv_id % 7 != 0 THEN max(end_ms) + conv_id % 4 * 4000 END AS duration_ms FROM seg GROUP BY conv_id), rec AS (SELECT * FROM known UNION ALL SELECT conv_id + 1000000, duration_ms FROM known WHERE conv_id % 10 = 0)"
_QC = f"""{_TURNS}, {_REC},
g AS (SELECT *, lag(coalesce(nullif(end_ms, 0), start_ms)) OVER w AS before, lag(start_ms, 1, -1000) OVER w AS previous FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
m AS (
  SELECT conv_id, count(*) AS turn_count, count(DISTINCT nullif(speaker, '')) AS speaker_count, count_if(end_ms - start_ms > 30000) AS long_turns, count_if(text = '') AS empty_turns,
    count_if(human_label = '' OR starts_with(human_label, 'SPEAKER_')) AS missing_human_labels, count_if(speaker IN ('', 'SPEAKER_UNKNOWN')) AS unknown_speakers, max(end_ms) AS last_ms,
    CASE WHEN count(*) > 1 THEN greatest(max(coalesce(nullif(start_ms, 0), before) - before), 0) END AS max_gap_ms, count_if(start_ms < previous) AS timestamp_regressions
  FROM g GROUP BY conv_id),
sp AS (SELECT conv_id, max(ms) AS top_ms, sum(ms) AS total_ms FROM (SELECT conv_id, speaker, CAST(sum(greatest(end_ms - start_ms, 0)) AS bigint) AS ms FROM turns GROUP BY ALL) GROUP BY conv_id),
q AS (
  SELECT rec.conv_id, m.conv_id IS NOT NULL AS canonical_exists, duration_ms AS source_duration_ms, coalesce(turn_count, 0) AS turn_count, coalesce(speaker_count, 0) AS speaker_count, coalesce(long_turns, 0) AS long_turns,
    coalesce(empty_turns, 0) AS empty_turns, coalesce(timestamp_regressions, 0) AS timestamp_regressions, coalesce(unknown_speakers, 0) AS unknown_speakers, coalesce(missing_human_labels, 0) AS missing_human_labels,
    CASE WHEN total_ms > 0 THEN top_ms::double / total_ms::double END AS speaker_time_ratio_max, last_ms AS last_timestamp_ms, CASE WHEN last_ms != 0 THEN duration_ms - last_ms END AS duration_delta_ms,
    CASE WHEN duration_ms > 0 THEN last_ms::double / duration_ms::double END AS coverage_ratio, max_gap_ms
  FROM rec LEFT JOIN m USING (conv_id) LEFT JOIN sp USING (conv_id))"""


def _notes(low: int, high: int) -> str:
    return f"""CASE WHEN NOT canonical_exists THEN 'missing_canonical' ELSE concat_ws('; ', CASE WHEN speaker_count < {low} OR speaker_count > {high} THEN 'speaker_count_outside_expected_{low}_{high}' END,
      CASE WHEN abs(duration_delta_ms) > 10000 THEN 'duration_delta_gt_10s' END, CASE WHEN missing_human_labels > 0 THEN 'missing_human_labels' END,
      CASE WHEN timestamp_regressions > 0 THEN 'timestamp_regressions' END, CASE WHEN unknown_speakers > 0 THEN 'unknown_speakers' END) END AS notes"""


_EVENT_TURNS = f"{B.EVENT}, t AS (SELECT user_id, event_id AS turn, start_s * 1000 AS start_ms, (start_s + dur_s) * 1000 AS end_ms, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS speaker FROM ev)"
_OVERLAP = "least({a}.end_ms, {b}.end_ms) - greatest({a}.start_ms, {b}.start_ms)"
_BEST = f"""best AS (
  SELECT conv_id, idx, widx, CASE WHEN speaker != '' THEN speaker END AS best_speaker, ov AS overlap_ms FROM (
    SELECT w.conv_id, w.idx, w.widx, d.speaker, {_OVERLAP.format(a='w', b='d')} AS ov, row_number() OVER (PARTITION BY w.conv_id, w.idx, w.widx ORDER BY {_OVERLAP.format(a='w', b='d')} DESC, d.idx) AS nth
    FROM word w JOIN span d ON w.conv_id = d.conv_id AND w.start_ms < d.end_ms AND d.start_ms < w.end_ms) WHERE nth = 1 AND ov > 0)"""
_SEGMENT_BEST = f"""seg_best AS (
  SELECT s.conv_id, s.idx, arg_max(d.speaker, ({_OVERLAP.format(a='s', b='d')}) * 1000 - d.idx) AS best_speaker, count(DISTINCT d.speaker) AS n_speakers
  FROM seg s JOIN span d ON s.conv_id = d.conv_id AND s.start_ms < d.end_ms AND d.start_ms < s.end_ms GROUP BY s.conv_id, s.idx)"""
_BLOCKS = f"""{_TURNS},
b0 AS (SELECT *, CASE WHEN trim(human_label) = '' THEN speaker ELSE upper({B.COLLAPSE.format('human_label')}) END AS who, {_BODY} AS body FROM turns),
b1 AS (SELECT *, CASE WHEN lag(who) OVER (PARTITION BY conv_id ORDER BY turn) = who THEN 0 ELSE 1 END AS fresh FROM b0),
b2 AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS block FROM b1)"""
_SENTENCES = r"""string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"""

ORACLE = {
    "turn_fold": f"{_TURNS} SELECT * FROM turns",
    "turn_fold_short_cap": f"WITH RECURSIVE {B.turns_sql(cap=40000)} SELECT * FROM turns",
    "turn_fold_keep_flags": f"{_TURNS} SELECT w.conv_id, CAST(w.turn AS bigint) AS turn, CASE WHEN bool_or(s.needs_review) THEN 'duvida' ELSE '' END AS flags, CASE WHEN bool_or(s.needs_review) THEN 'Revisar falante.' ELSE '' END AS notes FROM walk w JOIN s USING (conv_id, rn) GROUP BY w.conv_id, w.turn",
    "qc_metrics": f"{_QC} SELECT *, {_notes(2, 2)} FROM q",
    "qc_notes": f"{_QC} SELECT conv_id, {_notes(1, 1)} FROM q",
    "turn_gaps_and_regressions": f"""WITH {_EVENT_TURNS}, g AS (SELECT *, lag(coalesce(nullif(end_ms, 0), start_ms)) OVER w AS before, lag(start_ms, 1, -1000) OVER w AS previous FROM t WINDOW w AS (PARTITION BY user_id ORDER BY turn))
      SELECT user_id, count(*) AS turn_count, count(DISTINCT nullif(speaker, '')) AS speaker_count, count_if(end_ms - start_ms > 60000) AS long_turns, count_if(speaker = '') AS unknown_speakers, max(end_ms) AS last_ms,
        CASE WHEN count(*) > 1 THEN greatest(max(start_ms - before), 0) END AS max_gap_ms, count_if(start_ms < previous) AS timestamp_regressions FROM g GROUP BY user_id""",
    "speaker_time_ratio": f"WITH {_EVENT_TURNS} SELECT user_id, max(ms) AS top_ms, CAST(sum(ms) AS bigint) AS total_ms FROM (SELECT user_id, speaker, CAST(sum(greatest(end_ms - start_ms, 0)) AS bigint) AS ms FROM t GROUP BY ALL) GROUP BY user_id",
    "raw_metrics": f"""WITH {B.SEG}, {B.WORD}, a AS (SELECT conv_id, count(*) AS raw_segment_count, count_if(idx % 4 = 3) AS raw_segments_without_speaker, round(avg(CASE WHEN idx % 3 != 0 THEN -1.0::double * idx / 8 END), 6) AS raw_avg_logprob_mean FROM seg GROUP BY conv_id)
      SELECT a.*, coalesce(n, 0) AS raw_word_count, m AS raw_word_score_mean FROM a LEFT JOIN (SELECT conv_id, count(*) AS n, round(avg(score), 6) AS m FROM word GROUP BY conv_id) USING (conv_id)""",
    "best_overlap_speaker": f"WITH {B.SEG}, {B.SPAN}, {B.WORD}, {_BEST} SELECT * FROM best",
    "overlapping_speakers": f"WITH {B.SEG}, {B.SPAN}, {_SEGMENT_BEST} SELECT conv_id, idx, n_speakers FROM seg_best",
    "best_overlap_events": f"""WITH {B.EVENT}, i AS (SELECT user_id, event_id, event_type, start_s * 1000 AS start_ms, (start_s + 500 * dur_s) * 1000 AS end_ms FROM ev)
      SELECT user_id, event_id, best_speaker, overlap_ms FROM (
        SELECT w.user_id, w.event_id, 'u' || (d.event_id % 5) AS best_speaker, {_OVERLAP.format(a='w', b='d')} AS overlap_ms, row_number() OVER (PARTITION BY w.user_id, w.event_id ORDER BY {_OVERLAP.format(a='w', b='d')} DESC, d.event_id) AS nth
        FROM i w JOIN i d ON w.user_id = d.user_id AND w.event_type != 'click' AND d.event_type = 'click' AND w.start_ms < d.end_ms AND d.start_ms < w.end_ms) WHERE nth = 1 AND overlap_ms > 0""",
    "attributed_segments": f"""WITH {B.SEG}, {B.SPAN}, {B.WORD}, {_BEST}, {_SEGMENT_BEST},
      h AS (SELECT w.*, coalesce(best.best_speaker, seg.speaker) AS who FROM word w JOIN seg USING (conv_id, idx) LEFT JOIN best USING (conv_id, idx, widx) WHERE w.end_ms > w.start_ms),
      c AS (SELECT *, CASE WHEN lag(who) OVER (PARTITION BY conv_id, idx ORDER BY widx) = who THEN 0 ELSE 1 END AS fresh FROM h),
      g AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, idx ORDER BY widx) AS island FROM c),
      p AS (SELECT conv_id, idx, island, min_by(start_ms, widx) AS start_ms, max_by(end_ms, widx) AS end_ms, min(who) AS speaker, string_agg(word, ' ' ORDER BY widx) AS text, count(*) AS words, max(island) OVER (PARTITION BY conv_id, idx) AS n FROM g GROUP BY conv_id, idx, island)
      SELECT conv_id, idx, CAST(island - 1 AS bigint) AS sub, start_ms, end_ms, speaker, {B.COLLAPSE.format("regexp_replace(text, ' ([,.;:!?%)])', " + chr(39) + chr(92) + "1" + chr(39) + ", 'g')")} AS text, words, true AS split, false AS needs_review FROM p WHERE n > 1
      UNION ALL
      SELECT s.conv_id, s.idx, 0, s.start_ms, s.end_ms, coalesce(nullif(b.best_speaker, ''), s.speaker), {B.COLLAPSE.format('s.text')}, 0, false, coalesce(b.n_speakers > 1, false)
      FROM seg s LEFT JOIN seg_best b USING (conv_id, idx) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.conv_id = s.conv_id AND p.idx = s.idx AND p.n > 1)""",
    "span_merge_collar": f"""WITH {B.EVENT}, i AS (SELECT user_id, event_type, start_s * 1000 AS start_ms, (start_s + dur_s) * 1000 AS end_ms FROM ev WHERE dur_s >= 5),
      r AS (SELECT *, max(end_ms) OVER (PARTITION BY user_id, event_type ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
      g AS (SELECT *, sum(CASE WHEN start_ms - reach < 3600000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, event_type ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS grp FROM r)
      SELECT user_id, event_type, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS spans FROM g GROUP BY user_id, event_type, grp""",
    "speaker_rank": f"""WITH {B.SEG}, d AS (SELECT DISTINCT conv_id, CASE idx % 4 WHEN 0 THEN 'SPEAKER_10' WHEN 1 THEN 'SPEAKER_9' ELSE 'Ana' END AS speaker FROM seg WHERE idx % 4 != 3)
      SELECT conv_id, speaker, row_number() OVER (PARTITION BY conv_id ORDER BY CASE speaker WHEN 'SPEAKER_9' THEN 9 WHEN 'SPEAKER_10' THEN 10 ELSE 99 END) AS rank FROM d""",
    "speaker_label_join": f"""WITH {B.SEG}, d AS (SELECT conv_id, speaker, row_number() OVER (PARTITION BY conv_id ORDER BY speaker) AS rank FROM (SELECT DISTINCT conv_id, speaker FROM seg)),
      m AS (SELECT conv_id, speaker, arg_max(CASE WHEN idx % 2 = 0 THEN '' ELSE 'P' || idx END, idx) AS manual FROM seg WHERE conv_id % 5 = 0 GROUP BY ALL)
      SELECT d.conv_id, d.speaker, coalesce(nullif(manual, ''), CASE rank WHEN 1 THEN 'Entrevistador' WHEN 2 THEN 'Entrevistado' END, d.speaker) AS human_label FROM d LEFT JOIN m USING (conv_id, speaker)""",
    "readable_blocks": f"{_BLOCKS} SELECT conv_id, CAST(block AS bigint) AS block, min_by(start_ms, turn) AS start_ms, max_by(end_ms, turn) AS end_ms, min(who) AS speaker, min_by({_LABEL_OF}, turn) AS label, string_agg(body, ' ' ORDER BY turn) AS text FROM b2 GROUP BY conv_id, block",
    "paragraph_fold": f"""WITH RECURSIVE c AS (SELECT doc_id, {B.COLLAPSE.format('text')} AS t FROM documents WHERE text IS NOT NULL),
      s AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (SELECT doc_id, unnest(x) AS s, unnest(range(len(x))) AS i FROM (SELECT doc_id, {_SENTENCES} AS x FROM c)) WHERE s != ''),
      walk AS (
        SELECT doc_id, CAST(0 AS bigint) AS i, CAST('' AS varchar) AS cur, CAST(NULL AS varchar) AS out, false AS whole FROM c
        UNION ALL
        SELECT s.doc_id, s.i, CASE WHEN over THEN s.s WHEN len(cand) >= 850 AND regexp_matches(cand, '[.!?]$') THEN '' ELSE cand END, CASE WHEN over THEN prev WHEN len(cand) >= 850 AND regexp_matches(cand, '[.!?]$') THEN cand END, true
        FROM (SELECT s.doc_id, s.i, s.s, w.cur AS prev, CASE WHEN w.cur = '' THEN s.s ELSE w.cur || ' ' || s.s END AS cand, w.cur != '' AND len(w.cur || ' ' || s.s) > 1200 AS over
              FROM walk w JOIN s ON s.doc_id = w.doc_id AND s.i = w.i + 1) s),
      parts AS (SELECT doc_id, i, out AS p FROM walk WHERE out IS NOT NULL UNION ALL SELECT doc_id, 1000000000, arg_max(cur, i) FROM walk GROUP BY doc_id HAVING arg_max(cur, i) != ''),
      n AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS nth, count(*) OVER (PARTITION BY doc_id) AS total FROM parts),
      z AS (SELECT n.*, last.p AS tail FROM n JOIN n last ON last.doc_id = n.doc_id AND last.nth = n.total - 1)
      SELECT doc_id, CAST(nth AS bigint) AS nth, CASE WHEN total >= 2 AND len(tail) < 220 AND nth = total - 2 THEN p || ' ' || tail ELSE p END AS paragraph FROM z WHERE NOT (total >= 2 AND len(tail) < 220 AND nth = total - 1)""",
    "srt_cues": f"{_TURNS}, {_cues(',')} SELECT * FROM cues",
    "vtt_cues": f"{_TURNS}, {_cues('.')} SELECT * FROM cues",
    "srt_files": f"{_TURNS}, {_cues(',')} SELECT conv_id, string_agg(cue || chr(10) || times || chr(10) || text, chr(10) || chr(10) ORDER BY cue) || chr(10) AS content FROM cues GROUP BY conv_id",
    "nvivo_rows": f"{_TURNS} SELECT conv_id, turn, {_code('start_ms')} || '-' || {_code('end_ms')} AS \"Timespan\", coalesce(nullif(human_label, ''), speaker) AS \"Speaker\", {_BODY} AS \"Content\" FROM turns",
    "turns_csv_rows": f"""{_TURNS} SELECT CAST(conv_id AS varchar) AS interview_id, printf('turn_%06d', row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS turn_id, printf('%d.%03d', start_ms // 1000, start_ms % 1000) AS start,
      printf('%d.%03d', ({_END}) // 1000, ({_END}) % 1000) AS "end", {_code('start_ms')} AS start_timestamp, {_code(f'({_END})')} AS end_timestamp, speaker, human_label, flags, CASE WHEN flags = '' THEN '' ELSE 'Revisar falante.' END AS notes, text FROM turns""",
    "raw_asr_rows": rf"""WITH {B.SEG} SELECT conv_id, idx, start_ms || chr(9) || end_ms || chr(9) || trim(regexp_replace(text, '[\t\r\n]', ' ', 'g')) AS tsv, {_code('start_ms', ',')} || ' --> ' || {_code('end_ms', ',')} AS srt_times,
      trim(regexp_replace(replace(text, '-->', '->'), '[\r\n]+', ' ', 'g')) AS cue FROM seg""",
    "rttm_lines": f"WITH {B.SEG}, {B.SPAN} SELECT conv_id, idx, 'SPEAKER ' || conv_id || ' 1 ' || printf('%d.%03d', start_ms // 1000, start_ms % 1000) || ' ' || printf('%d.%03d', (end_ms - start_ms) // 1000, (end_ms - start_ms) % 1000) || ' <NA> <NA> ' || speaker || ' <NA> <NA>' AS line FROM span",
    "stab_lookup": f"{_TURNS}, p AS (SELECT conv_id, unnest(range(0, max(end_ms) + 1, 7000)) AS at_ms FROM turns GROUP BY conv_id) SELECT p.conv_id, p.at_ms, min(t.turn) AS turn FROM p LEFT JOIN turns t ON t.conv_id = p.conv_id AND t.start_ms <= p.at_ms AND p.at_ms < t.end_ms GROUP BY p.conv_id, p.at_ms",
}
