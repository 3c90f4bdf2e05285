"""Queries over review edits, one kind at a time, so that SQL can say what each gives; and documents of whole recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..operators import review
from . import bindings as B
from . import transcripts as TR
from .chain import BLOCK_PARAGRAPHS

CAP = 40_000


def _turns(spark, d) -> DataFrame:
    """Written, as turns and edits both come from them."""
    return shared.written(review.normalize(TR.all_turns(spark, d, CAP).withColumn("interview_id", F.col("conv_id").cast("string"))), "turns")


def _edited(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """All columns of the replayed turns; ``edits`` has interview_id, seq, action, turn_id and payload."""
    out = review.replay(turns, edits)
    return out.select(F.col("interview_id").cast("bigint").alias("conv_id"), F.col("pos").cast("bigint").alias("pos"), "turn_id", "start_ms", "end_ms", "speaker", "human_label", F.md5("text").alias("text"), F.array_join("flags", ";").alias("flags"), "notes", "edited", F.col("refused").cast("bigint").alias("refused"))


def _payload(**values: Column) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))


def _each(turns: DataFrame, action: Column, payload: Column, where: str = "true") -> DataFrame:
    """One edit for each of some turns, in order of the turns."""
    return turns.where(where).select("interview_id", F.col("pos").cast("bigint").alias("seq"), action.alias("action"), "turn_id", payload.alias("payload"))


def review_values(spark, d):
    """Text, speaker, times (some refused), flags."""
    t = _turns(spark, d)
    kinds = F.element_at(F.array(*map(F.lit, ("set_text", "set_speaker", "set_times", "toggle_flag", "set_flags", "bogus"))), F.col("pos") % 6 + 1)
    n = F.col("pos")
    payload = _payload(text=F.concat(F.lit("  new "), n.cast("string"), F.lit(" ")), human_label=F.lit("Ana"), start_ms=F.col("start_ms") + 10, end_ms=F.when(n % 4 == 0, F.col("start_ms")).otherwise(F.col("end_ms") + 10), flag=F.lit("duvida"), flags=F.lit("b| a |b|"))
    return _edited(t, _each(t, kinds, payload))


def review_merge(spark, d):
    """E5: each turn at an even place with the next, where they have one speaker."""
    t = _turns(spark, d)
    return _edited(t, _each(t, F.lit("merge_next"), _payload(), "pos % 2 = 0"))


def review_split(spark, d):
    """Every third turn in two, at the space nearest to the middle or a given character, at the time in proportion or a given one."""
    t = _turns(spark, d)
    payload = _payload(char=F.when(F.col("pos") % 2 == 0, F.lit("")).otherwise(F.lit("7")), at_ms=F.when(F.col("pos") % 4 == 0, F.col("start_ms") + 3))
    return _edited(t, _each(t, F.lit("split"), payload, "pos % 3 = 0"))


def review_boundary(spark, d):
    """Ends of turns at even places, beyond the next turn for some."""
    t = _turns(spark, d)
    time = F.when(F.col("pos") % 4 == 0, F.col("end_ms") + 100).when(F.col("pos") % 8 == 2, F.col("start_ms")).otherwise(F.col("end_ms") + 10_000_000)
    return _edited(t, _each(t, F.lit("move_boundary"), _payload(edge=F.lit("end"), at_ms=time), "pos % 2 = 0"))


def review_undo(spark, d):
    """Entries that are taken back and put back."""
    t = _turns(spark, d)
    first = t.where("pos = 0").select("interview_id", "turn_id")
    logs = (("A", "B", "undo"), ("A", "undo", "redo"), ("A", "undo", "B", "redo"), ("undo", "A", "undo", "undo", "redo", "redo"))
    log = F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in logs)), F.pmod(F.col("interview_id").cast("int"), F.lit(4)) + 1)
    each = first.select("interview_id", "turn_id", F.posexplode(log).alias("seq", "what"))
    edits = each.select("interview_id", F.col("seq").cast("bigint").alias("seq"), F.when(F.col("what").isin("A", "B"), F.lit("set_text")).otherwise(F.col("what")).alias("action"), "turn_id", _payload(text=F.col("what")).alias("payload"))
    return _edited(t, edits)


def review_versions(spark, d):
    """The version after one of three entries, of all recordings."""
    t = _turns(spark, d)
    edits = t.where("pos = 0").select("interview_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("seq"), F.lit("set_text").alias("action"), "turn_id").withColumn("payload", _payload(text=F.col("seq")))
    return review.replay(t, edits, upto=2).where("pos = 0").select(F.col("interview_id").cast("bigint").alias("conv_id"), "text")


def edit_log(spark, d):
    """E8."""
    at = F.timestamp_seconds(F.col("l_orderkey") * 60 + F.col("l_linenumber"))
    edits = B.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("interview_id"), at.alias("at"), F.when(F.col("l_linenumber") % 2 == 0, F.lit("set_text")).otherwise(F.lit("split")).alias("action"), F.format_string("turn_%06d", F.col("l_linenumber")).alias("turn_id"), _payload(text=F.lit("x")).alias("payload"))
    return review.edit_log(edits).select("interview_id", F.unix_seconds("at").alias("at"), "action", "turn_id")


QUERIES = {f.__name__: f for f in (review_values, review_merge, review_split, review_boundary, review_undo, review_versions, edit_log)}

_T = f"""WITH RECURSIVE {B.turns_sql(cap=CAP)},
t AS (SELECT conv_id, turn AS pos, printf('turn_%06d', turn + 1) AS turn_id, start_ms, end_ms, speaker, human_label, text, flags, CASE WHEN flags = '' THEN '' ELSE 'Revisar falante.' END AS notes, false AS edited, count(*) OVER (PARTITION BY conv_id) AS total FROM turns)"""
_KEY = "CASE WHEN trim({0}.human_label) = '' THEN {0}.speaker ELSE upper(" + B.COLLAPSE.format("{0}.human_label") + ") END"
_OUT = "conv_id, pos, turn_id, start_ms, end_ms, speaker, human_label, md5(text) AS text, flags, notes, edited, CAST(refused AS bigint) AS refused"
_UNION = "array_to_string(list_sort(list_distinct(list_filter(string_split({0}, ';') || string_split({1}, ';'), lambda x: x != ''))), ';')"
ORACLE = {
    "review_values": f"""{_T},
      e AS (SELECT *, pos % 6 AS k, pos % 6 = 5 OR (pos % 6 = 2 AND CASE WHEN pos % 4 = 0 THEN start_ms ELSE end_ms + 10 END <= start_ms + 10) AS bad FROM t)
      SELECT conv_id, pos, turn_id, CASE WHEN k = 2 AND NOT bad THEN start_ms + 10 ELSE start_ms END AS start_ms, CASE WHEN k = 2 AND NOT bad THEN end_ms + 10 ELSE end_ms END AS end_ms, speaker, CASE WHEN k = 1 THEN 'Ana' ELSE human_label END AS human_label,
        md5(CASE WHEN k = 0 THEN 'new ' || pos ELSE text END) AS text, CASE WHEN k = 3 THEN CASE WHEN flags = 'duvida' THEN '' ELSE 'duvida' END WHEN k = 4 THEN 'a;b' ELSE flags END AS flags, notes, NOT bad AS edited, CAST(count_if(bad) OVER (PARTITION BY conv_id) AS bigint) AS refused FROM e""",
    "review_merge": f"""{_T},
      m AS (SELECT a.*, b.pos IS NOT NULL AND {_KEY.format("a")} = {_KEY.format("b")} AS joins, b.start_ms AS bs, b.end_ms AS be, b.text AS bt, b.flags AS bf, b.notes AS bn FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id AND b.pos = a.pos + 1 AND a.pos % 2 = 0),
      k AS (SELECT *, lag(joins, 1, false) OVER (PARTITION BY conv_id ORDER BY pos) AND pos % 2 = 1 AS gone, count_if(pos % 2 = 0 AND NOT joins) OVER (PARTITION BY conv_id) AS refused FROM m),
      r AS (SELECT *, pos % 2 = 0 AND joins AS did FROM k WHERE NOT gone)
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS pos, turn_id, CASE WHEN did THEN least(start_ms, bs) ELSE start_ms END AS start_ms, CASE WHEN did THEN greatest(end_ms, be) ELSE end_ms END AS end_ms, speaker, human_label,
        md5(CASE WHEN did THEN trim(trim(text) || ' ' || trim(bt)) ELSE text END) AS text, CASE WHEN did THEN {_UNION.format("flags", "bf")} ELSE flags END AS flags, CASE WHEN did THEN trim(trim(notes) || ' ' || trim(bn)) ELSE notes END AS notes, did AS edited, CAST(refused AS bigint) AS refused FROM r""",
    "review_split": f"""{_T},
      a AS (SELECT *, len(text) // 2 AS mid FROM t),
      b AS (SELECT *, CASE WHEN contains(left(text, mid), ' ') THEN mid - strpos(reverse(left(text, mid)), ' ') ELSE 0 END AS lo, CASE WHEN contains(substr(text, mid + 1), ' ') THEN mid + strpos(substr(text, mid + 1), ' ') - 1 ELSE 0 END AS hi FROM a),
      c AS (SELECT *, CASE WHEN pos % 2 = 1 AND len(text) > 7 THEN 7 WHEN lo > 0 AND (hi <= 0 OR mid - lo <= hi - mid) THEN lo WHEN hi > 0 THEN hi ELSE mid END AS ch FROM b),
      e AS (SELECT *, trim(left(text, ch)) AS l, trim(substr(text, ch + 1)) AS r, pos % 3 = 0 AS asked FROM c),
      f AS (SELECT *, asked AND l != '' AND r != '' AS did, CASE WHEN pos % 4 = 0 AND start_ms + 3 > start_ms AND start_ms + 3 < end_ms THEN start_ms + 3 ELSE CAST(round_even(start_ms + (end_ms - start_ms) * ch / greatest(len(text), 1)::double, 0) AS bigint) END AS cut FROM e),
      g AS (SELECT *, count_if(asked AND NOT did) OVER (PARTITION BY conv_id) AS refused, total + count_if(did) OVER (PARTITION BY conv_id ORDER BY pos) AS number FROM f),
      h AS (
        SELECT conv_id, pos, 0 AS half, turn_id, start_ms, CASE WHEN did THEN cut ELSE end_ms END AS end_ms, speaker, human_label, CASE WHEN did THEN l ELSE text END AS text, flags, notes, did AS edited, refused FROM g
        UNION ALL SELECT conv_id, pos, 1, printf('turn_%06d', number), cut, end_ms, speaker, human_label, r, flags, notes, true, refused FROM g WHERE did)
      SELECT {_OUT} FROM (SELECT * EXCLUDE (pos, half), row_number() OVER (PARTITION BY conv_id ORDER BY pos, half) - 1 AS pos FROM h)""",
    "review_boundary": f"""{_T},
      e AS (SELECT *, CASE WHEN pos % 2 = 0 THEN CASE WHEN pos % 4 = 0 THEN end_ms + 100 WHEN pos % 8 = 2 THEN start_ms ELSE end_ms + 10000000 END END AS goal FROM t),
      f AS (SELECT *, goal IS NOT NULL AND goal > start_ms AS did FROM e),
      g AS (SELECT *, lag(CASE WHEN did THEN goal END) OVER (PARTITION BY conv_id ORDER BY pos) AS before, count_if(goal IS NOT NULL AND NOT did) OVER (PARTITION BY conv_id) AS refused FROM f),
      h AS (SELECT *, coalesce(before < end_ms, false) AND pos % 2 = 1 AS moved FROM g)
      SELECT {_OUT.replace("start_ms,", "CASE WHEN moved THEN before ELSE start_ms END AS start_ms,").replace("end_ms,", "CASE WHEN did THEN goal ELSE end_ms END AS end_ms,").replace("edited,", "did OR moved AS edited,")} FROM h""",
    "review_undo": f"""{_T} SELECT {_OUT.replace("md5(text) AS text", "md5(CASE WHEN pos > 0 THEN text ELSE CASE conv_id % 4 WHEN 2 THEN 'B' ELSE 'A' END END) AS text").replace("edited,", "pos = 0 AS edited,")} FROM (SELECT *, 0 AS refused FROM t)""",
    "review_versions": f"{_T} SELECT conv_id, '1' AS text FROM t WHERE pos = 0",
    "edit_log": "SELECT CAST(l_suppkey AS varchar) AS interview_id, l_orderkey * 60 + l_linenumber AS at, CASE WHEN l_linenumber % 2 = 0 THEN 'set_text' ELSE 'split' END AS action, printf('turn_%06d', l_linenumber) AS turn_id FROM lineitem",
    "canonical_json": f"""{TR._TURNS}, j AS (SELECT conv_id, turn, '{{"start":' || regexp_replace(printf('%d.%03d', start_ms // 1000, start_ms % 1000), '([.][0-9]+?)0+$', '\\1') || ',"end":' || regexp_replace(printf('%d.%03d', end_ms // 1000, end_ms % 1000), '([.][0-9]+?)0+$', '\\1') || ',"speaker":' || CAST(to_json(speaker) AS varchar)
        || ',"human_label":' || CAST(to_json(human_label) AS varchar) || ',"text":' || CAST(to_json(text) AS varchar) || ',"flags":' || CASE WHEN flags = '' THEN '[]' ELSE '["duvida"]' END || ',"notes":' || CASE WHEN flags = '' THEN '""' ELSE '"Revisar falante."' END || '}}' AS j FROM turns)
      SELECT conv_id, '{{"conv_id":' || conv_id || ',"turns":[' || string_agg(j, ',' ORDER BY turn) || ']}}' AS content FROM j GROUP BY conv_id""",
    "markdown_files": f"""{BLOCK_PARAGRAPHS},
      whole AS (SELECT gid, string_agg(paragraph, chr(10) || chr(10) ORDER BY nth) AS body FROM para GROUP BY gid),
      heads AS (SELECT conv_id, block, min_by(start_ms, turn) AS began, min_by({TR._LABEL_OF}, turn) AS label FROM b2 WHERE body != '' GROUP BY conv_id, block),
      lines AS (SELECT conv_id, block, '[' || printf('%02d:%02d:%02d', CAST(round_even(began / 1000.0::double, 0) AS bigint) // 3600, CAST(round_even(began / 1000.0::double, 0) AS bigint) // 60 % 60, CAST(round_even(began / 1000.0::double, 0) AS bigint) % 60) || '] **' || label || ':** ' || body AS line
        FROM heads JOIN whole ON whole.gid.c = conv_id AND whole.gid.b = block)
      SELECT r.conv_id, '# ' || r.conv_id || coalesce(chr(10) || chr(10) || content, chr(10)) AS content FROM (SELECT DISTINCT conv_id FROM turns) r LEFT JOIN (SELECT conv_id, rtrim(string_agg(line, chr(10) || chr(10) ORDER BY block)) || chr(10) AS content FROM lines GROUP BY conv_id) USING (conv_id)""",
}
