"""Queries in which few keys hold all rows: running values over key ranges, overlaps and stabbing without pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scans, sweep
from ..operators.scans import Running
from .bindings import EVENT, event_intervals


def _hot(spark, d):
    """Events as stretches of milliseconds; a third of all under one key."""
    ev = event_intervals(spark, d)
    return ev.select(F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id") % 5 + 1).cast("bigint").alias("k"), "event_id", "event_type", (F.col("start_s") * 1000).alias("start_ms"), ((F.col("start_s") + 20 * F.col("dur_s")) * 1000).alias("end_ms"), "dur_s")


def scan_running(spark, d):
    """Running values of few keys."""
    wanted = {"top": Running("max", "dur_s"), "reach": Running("max", "end_ms", before=True), "total": Running("sum", "dur_s"), "nth": Running("count"), "previous": Running("last", "event_type"), "island": Running("runs", "event_type")}
    return scans.running(_hot(spark, d), ["k"], ["start_ms", "event_id"], wanted).select("k", "event_id", *wanted)


def scan_merge_spans(spark, d):
    """W11 over few keys."""
    return scans.merge_spans(_hot(spark, d), ["k"], 500, 5000)


def scan_progress(spark, d):
    """Progress that never falls, over few keys."""
    rows = _hot(spark, d).select("k", "event_id", (F.col("dur_s") % 120).alias("progress"))
    return scans.monotone(rows, ["k"], "event_id", cap=90).select("event_id", F.col("shown").cast("bigint").alias("shown"))


def sweep_overlaps(spark, d):
    """J1, J2 over few keys: every second event against the others."""
    ev = _hot(spark, d).withColumnRenamed("k", "interview_id")
    items, spans = ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1").select("interview_id", F.col("event_id").alias("idx"), "start_ms", "end_ms", F.col("event_type").alias("speaker"))
    return sweep.best_overlap(items, spans, ["event_id"], look=True).select("event_id", "best_speaker", "overlap_ms", "n_speakers")


def sweep_stab(spark, d):
    """J14 over few keys: the first stretch around the middle of each."""
    ev = _hot(spark, d).withColumnRenamed("k", "interview_id")
    points = ev.select("interview_id", "event_id", F.expr("(start_ms + end_ms) div 2").alias("at_ms"))
    return sweep.stab(points, ev.withColumnRenamed("event_id", "turn")).select("event_id", "turn")


QUERIES = {f.__name__: f for f in (scan_running, scan_merge_spans, scan_progress, sweep_overlaps, sweep_stab)}

_H = f"WITH {EVENT}, h AS (SELECT CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 5 + 1 END AS k, event_id, event_type, start_s * 1000 AS start_ms, (start_s + 20 * dur_s) * 1000 AS end_ms, dur_s FROM ev)"
ORACLE = {
    "scan_running": f"""{_H}, l AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY k ORDER BY start_ms, event_id) = event_type THEN 0 ELSE 1 END AS fresh FROM h)
      SELECT k, event_id, max(dur_s) OVER w AS top, max(end_ms) OVER (PARTITION BY k ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, CAST(sum(dur_s) OVER w AS bigint) AS total, count(*) OVER w AS nth,
        lag(event_type) OVER w AS previous, CAST(sum(fresh) OVER w AS bigint) AS island FROM l WINDOW w AS (PARTITION BY k ORDER BY start_ms, event_id)""",
    "scan_merge_spans": f"""{_H}, r AS (SELECT *, max(end_ms) OVER (PARTITION BY k ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, row_number() OVER (PARTITION BY k ORDER BY start_ms, end_ms) AS n FROM h WHERE end_ms - start_ms >= 5000),
      g AS (SELECT *, sum(CASE WHEN start_ms - reach < 500 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY n) AS grp FROM r)
      SELECT k, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS spans FROM g GROUP BY k, grp""",
    "scan_progress": f"{_H} SELECT event_id, CAST(least(max(dur_s % 120) OVER (PARTITION BY k ORDER BY event_id), 90) AS bigint) AS shown FROM h",
    "sweep_overlaps": f"""{_H}, m AS (SELECT i.event_id, s.event_id AS idx, s.event_type AS who, least(i.end_ms, s.end_ms) - greatest(i.start_ms, s.start_ms) AS ms FROM h i JOIN h s ON i.k = s.k AND i.start_ms < s.end_ms AND s.start_ms < i.end_ms WHERE i.event_id % 2 = 0 AND s.event_id % 2 = 1),
      b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ms DESC, idx) AS nth FROM m WHERE ms > 0), n AS (SELECT event_id, count(DISTINCT who) AS n_speakers FROM m WHERE ms > 0 GROUP BY event_id)
      SELECT event_id, who AS best_speaker, ms AS overlap_ms, n_speakers FROM b JOIN n USING (event_id) WHERE nth = 1""",
    "sweep_stab": f"{_H}, p AS (SELECT k, event_id, (start_ms + end_ms) // 2 AS t FROM h) SELECT p.event_id, min(h.event_id) AS turn FROM p LEFT JOIN h ON h.k = p.k AND h.start_ms <= p.t AND p.t < h.end_ms GROUP BY p.event_id",
}
