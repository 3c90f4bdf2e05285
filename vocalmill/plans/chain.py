"""Queries that chain the steps: documents to turns, reports over files, manifests, the trash, files written and read again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared
from ..functions import media as M
from ..functions import text as X
from ..operators import folds, library, progress, render, trash, turns, waveform
from ..schemas import MANIFEST_COLUMNS, PROBE_COLUMNS, QC_COLUMNS
from ..session import ship
from ..sources import readers, writers
from ..streaming import events as S
from . import bindings as B
from . import library as L
from . import transcripts as TR
from .streams import _collected, _event_stream, _folder


def _documents(spark, d) -> DataFrame:
    """(conv_id, document): recogniser output with words, from the segments."""
    each = B.segments(spark, d).withColumn("w", F.split(X.collapse(F.col("text")), " ")).withColumns({"n": F.size("w"), "dur": F.col("end_ms") - F.col("start_ms")})
    timed = F.expr("transform(w, (x, i) -> named_struct('word', x, 'start', (start_ms + dur * i div n) / 1000, 'end', (start_ms + dur * (i + 1) div n) / 1000))")
    words = F.filter(timed, lambda x: x["word"] != "")
    rows = each.withColumn("words", F.when(F.size(words) > 0, words))
    segment = F.struct((F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text", "speaker", F.col("needs_review").alias("needs_speaker_review"), "words")
    each = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", segment.alias("s")))).alias("r"))
    return each.select("conv_id", F.to_json(F.struct(F.col("r.s").alias("segments"))).alias("document"))


def _manifest(spark, d) -> DataFrame:
    """A row a recording, those of every eleventh not selected; durations as text; one recording in thirteen has no document."""
    known = B.segments(spark, d).groupBy("conv_id").agg(F.max("end_ms").alias("e"))
    own = known.selectExpr("conv_id", "CASE WHEN conv_id % 11 = 0 THEN 'false' ELSE 'true' END AS selected", "CASE WHEN conv_id % 7 = 0 THEN '' ELSE format_string('%d.%03d', (e + conv_id % 4 * 4000) div 1000, (e + conv_id % 4 * 4000) % 1000) END AS duration_sec")
    return own.unionByName(known.where("conv_id % 13 = 0").selectExpr("conv_id + 1000000 AS conv_id", "'true' AS selected", "'7.250' AS duration_sec"))


def _rendered(spark, d, manifest=None) -> render.Rendered:
    known = shared.written(_manifest(spark, d), "manifest") if manifest is None else manifest
    return render.render(known, shared.written(_documents(spark, d), "documents"), B.spans(spark, d), list(B.LABELS), key="conv_id")


def render_turns(spark, d):
    t = _rendered(spark, d).turns
    return t.select("conv_id", "turn", "start_ms", "end_ms", "speaker", "human_label", "text", F.col("segments").cast("bigint").alias("segments"), F.array_join("flags", ";").alias("flags"), "notes")


def render_missing(spark, d):
    return _rendered(spark, d).missing


def render_files(spark, d):
    done = _rendered(spark, d)
    out = None
    for name, files in done.files().items():
        one = files.select("conv_id", F.lit(name).alias("format"), F.md5("content").alias("h"))
        out = one if out is None else out.unionByName(one)
    return out.where("format = 'srt'")


def render_report(spark, d):
    manifest = shared.written(_manifest(spark, d), "manifest")
    done = _rendered(spark, d, manifest)
    k = F.col("conv_id")
    paths = [F.when(k % n != 0, F.concat(F.lit(before), k.cast("string"), F.lit(after))) for n, before, after in ((5, "/p/json/", ".canonical.json"), (4, "/p/json/", ".whisperx.json"), (3, "/p/wav/", ".wav"), (2, "/p/json/", ".regular.json"), (9, "/p/json/", ".exclusive.json"))]
    listing = manifest.where("conv_id < 1000000").select(F.explode(F.array_compact(F.array(*paths))).alias("path"))
    return render.report(done, manifest, listing, max_turn_ms=30000)


def manifest_rows(spark, d):
    files = L._files(spark, d).selectExpr("path", "size", "timestamp_seconds(size) AS mtime")
    forms = L._sql(spark, L._NAMES, d, "customer").where("c_custkey % 2 = 0").select("path")
    names = files.where("size % 2 = 0").selectExpr("regexp_replace(path, 'File', 'B01R_') AS path", "size", "mtime")
    probes = files.where("size % 3 = 0").select("path", *(F.lit("").alias(c) if c not in ("duration_sec", "probe_status") else F.lit("ok" if c == "probe_status" else "1.500").alias(c) for c in PROBE_COLUMNS))
    hashes = files.where("size % 5 != 1").selectExpr("path", "md5(path) AS sha256")
    return library.build_manifest([files.where("size % 4 != 1"), names], (".wav", ".m4a", ".mp4", ".mov"), forms, probes, hashes, "/lib").drop("__choice")


def selected_ids(spark, d):
    """P1."""
    return library.selected_rows(_manifest(spark, d), None, "conv_id").select("conv_id", "duration_sec")


def _table_rows(tables: dict[str, DataFrame], what: str) -> DataFrame:
    detail = {"manifest": "source_path", "metadata": "title", "speakers_map": "speaker_label", "jobs": "concat(status, ' ', progress)"}
    out = None
    for name, df in sorted(tables.items()):
        one = df.select(F.lit(what).alias("what"), F.lit(name).alias("name"), F.col(trash.KEYS[name][0]).cast("bigint").alias("id"), F.expr(detail[name]).alias("detail"))
        out = one if out is None else out.unionByName(one)
    return out


def trash_round_trip(spark, d):
    """Rows left, saved and after restoring, the files to move, those in the way, and the entries after purging."""
    tables = L._tables(spark, d)
    tables["jobs"] = tables["jobs"].withColumn("status", F.expr("CASE WHEN file_id % 27 = 4 THEN 'Rodando' ELSE status END"))
    files = table_files(spark, d)
    left, saved, moved = trash.move(tables, L._ids(spark, d), files, "t1", "/p/.trash")
    back, copied, taken = trash.bring_back(left, saved, moved, files.where("size % 2 = 0").selectExpr("path", "size", "size AS mtime"))
    entries = spark.createDataFrame([("t1", "trashed"), ("t2", "restored")], "trash_id string, status string")
    after, gone = trash.purge(entries, moved, entries.select("trash_id"))
    row = lambda df, what, path, detail: df.selectExpr(f"'{what}' AS what", "'files' AS name", "CAST(size AS bigint) AS id", f"{path} AS detail") if detail else df
    out = _table_rows(left, "left").unionByName(_table_rows(saved, "saved")).unionByName(_table_rows(back, "back"))
    out = out.unionByName(row(moved, "moved", "trashed_path", True)).unionByName(row(copied, "copied", "original_path", True)).unionByName(row(taken, "taken", "original_path", True)).unionByName(row(gone, "gone", "trashed_path", True))
    return out.unionByName(after.selectExpr("'entry' AS what", "trash_id AS name", "CAST(0 AS bigint) AS id", "status AS detail"))


def table_files(spark, d) -> DataFrame:
    """Two files of each recording."""
    return B.table(spark, d, "customer").selectExpr("c_custkey AS size", "explode(array(concat('/p/json/', c_custkey, '.canonical.json'), concat('/p/wav/', c_custkey, '.wav'))) AS path")


def csv_round_trip(spark, d):
    """K1, S3, O2: one sorted CSV file with a byte order mark, read again, with the place of each row in the file."""
    rows = B.table(spark, d, "customer").selectExpr("CAST(c_custkey AS string) AS interview_id", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(c_name, ', \"', c_mktsegment, '\"') END AS title", "CASE WHEN c_custkey % 2 = 0 THEN concat('a', chr(10), 'é') END AS notes", "c_custkey AS k")
    path = _folder(spark, "csv")
    writers.write_csv_file(rows, path, ["interview_id", "title", "notes"], ["k"])
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("interview_id", "title", "notes", "more")])
    back = readers.csv_table(spark, path, schema)
    return back.withColumn("place", F.monotonically_increasing_id() + 1)  # one small file is one partition


def json_round_trip(spark, d):
    """A document a recording, written to its own folder and read whole, a broken one among them."""
    docs = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("interview_id"), F.when(F.col("n_nationkey") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("n_name", "n_regionkey"), {"pretty": "true"})).alias("content"))
    path = _folder(spark, "json")
    writers.write_contents(docs, path)
    back = readers.json_documents(spark, path)
    return back.select(F.regexp_extract("path", r"interview_id=(\d+)", 1).cast("bigint").alias("n_nationkey"), "corrupt", F.get_json_object("document", "$.n_name").alias("n_name"), F.get_json_object("document", "$.n_regionkey").cast("bigint").alias("n_regionkey"))


def log_round_trip(spark, d):
    """Events appended to a log in two turns, read again, and counted."""
    ev = B.event_intervals(spark, d).selectExpr("CAST(user_id AS string) AS interview_id", "event_type AS stage", "CASE WHEN dur_s % 4 = 0 THEN 'failed' ELSE 'ok' END AS status", "CAST(dur_s % 100 AS int) AS progress", "event_id")
    path = _folder(spark, "log")
    for k in range(2):
        writers.append_log(ev.where(f"event_id % 2 = {k}").drop("event_id"), path)
    log = readers.job_log(spark, path)
    return log.groupBy("stage", "status").agg(F.count("*").alias("n"), F.sum("progress").alias("progress"), F.count("model").alias("models"))


def settings_round_trip(spark, d):
    """Settings of each nation as lines, and what is read from them."""
    rows = B.table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # a fixed table of 25 rows
    out = []
    for r in rows:
        lines = writers.settings_lines({"name": f"{r.n_name}: #1".replace("#", "no "), "key": r.n_nationkey, "half": r.n_nationkey / 2, "even": r.n_nationkey % 2 == 0, "none": None, "list": [r.n_name, r.n_nationkey]})
        got = readers.parse_settings(lines + "comment: 5 # not this\n")
        out += [(r.n_nationkey, k, "null" if v is None else str(v)) for k, v in got.items()]
    return spark.createDataFrame(out, "n_nationkey bigint, name string, value string")


def wav_samples(spark, d):
    """WAV files of 16-bit stereo samples, decoded, and their peaks of ten samples."""

    @F.pandas_udf("binary")
    def wav(values: pd.Series) -> pd.Series:
        import io
        import wave

        import numpy as np

        def one(v) -> bytes:
            data = io.BytesIO()
            with wave.open(data, "wb") as file:
                file.setnchannels(2)
                file.setsampwidth(2)
                file.setframerate(8000)
                file.writeframes(np.repeat(np.asarray(v, "<i2"), 2).tobytes())
            return data.getvalue()

        return values.map(one)

    ship(spark)
    sample = F.struct("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)).alias("v"))
    files = B.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("path")).agg(F.array_sort(F.collect_list(sample)).alias("s"))
    return waveform.wav_peaks(files.select("path", wav(F.col("s.v")).alias("content")), 10).select(F.col("file_id").cast("bigint").alias("l_suppkey"), "peak_idx", "peak", F.col("rate").cast("bigint").alias("rate"))


def sizes_as_text(spark, d):
    """P29, P31."""
    n = F.col("o_orderkey")
    size = n * n * F.element_at(F.array(F.lit(1), F.lit(37), F.lit(4099)), (n % 3 + 1).cast("int"))
    return B.table(spark, d, "orders").select("o_orderkey", X.size_text(size).alias("size"), X.duration_text(n % 9000).alias("duration"), M.iso_utc(F.timestamp_seconds(n * 7919)).alias("mtime"))


def turn_ids(spark, d):
    """Ids of a review's turns: given ones, repeated ones and none."""
    from ..operators import review

    given = B.segments(spark, d).selectExpr("CAST(conv_id AS string) AS interview_id", "idx AS turn", "CASE WHEN idx % 3 = 0 THEN concat(' x_', idx % 4, ' ') WHEN idx % 3 = 1 THEN '' END AS turn_id", "start_ms", "end_ms", "speaker", "text")
    return review.normalize(given).select(F.col("interview_id").cast("bigint").alias("conv_id"), F.col("pos").cast("bigint").alias("pos"), "turn_id", "human_label", "notes", "edited")


def paragraph_fold_chunks(spark, d):
    """W10 over several texts: each line of a document is one."""
    docs = B.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("texts"))
    return folds.exploded(folds.paragraphs(docs), ["doc_id"], "paragraphs", "nth", "paragraph")


def block_paragraphs(spark, d):
    b = turns.blocks(TR.all_turns(spark, d), "conv_id")
    return folds.exploded(b.withColumn("block", F.col("block").cast("bigint")), ["conv_id", "block"], "paragraphs", "nth", "paragraph")


def vtt_files(spark, d):
    return writers.vtt(TR.all_turns(spark, d), "conv_id")


def export_formats(spark, d):
    """All formats of all recordings, from what is in their folders afterwards (documents of programs that are not installed apart)."""
    folder = _folder(spark, "export")
    t = TR.all_turns(spark, d).withColumn("interview_id", F.col("conv_id").cast("string"))
    done = writers.export(t, folder)
    found = None
    for name in (n for n in done if n in ("md", "srt", "vtt")):
        one = readers.named_files(spark, f"{folder}/{name}", writers.FORMATS[name][0], "conv_id").select(F.lit(name).alias("format"), F.col("conv_id").cast("bigint").alias("conv_id"))
        found = one if found is None else found.unionByName(one)
    for name, sep in (("csv", ","), ("tsv", "\t")):
        rows = readers.named_tables(spark, f"{folder}/{name}", writers.FORMATS[name][0], ["interview_id"], sep)
        found = found.unionByName(rows.select(F.lit(name).alias("format"), F.col("interview_id").cast("bigint").alias("conv_id")))
    return found.groupBy("format", "conv_id").agg(F.count("*").alias("n"))


def download_progress(spark, d):
    """ST5: percentages from the sizes of a folder, held at their peak; as a table and as a stream they are the same."""
    stream = _event_stream(spark, d).select("file_id", "seq", progress.download_percent(F.col("progress") * 10 + F.col("seq") % 50, F.lit(30), F.lit(1000), 10, 60).alias("progress"))
    found = _collected(spark, S.held_progress(stream, cap=60), "append")
    return found.select(F.col("file_id").cast("bigint").alias("file_id"), "seq", "shown")


def recogniser_variants(spark, d):
    """A recogniser of two variants behind the seam; each variant's documents in a folder of their own."""

    def model(frames):
        for frame in frames:
            yield pd.DataFrame({"interview_id": frame["interview_id"], "variant": frame["variant"], "document": ['{"segments": [{"start": 0, "end": 1.5, "text": "%s %s"}]}' % (v, i) for i, v in zip(frame["interview_id"], frame["variant"], strict=True)]})

    audio = B.table(spark, d, "supplier").selectExpr("CAST(s_suppkey AS string) AS interview_id", "explode(array('base', 'big model!')) AS variant")
    base = _folder(spark, "asr")
    done = S.transcribe(audio, model)
    out = None
    for variant in ("base", "big model!"):
        folder = writers.variant_folder(f"{base}/usual", f"{base}/variants", "" if variant == "base" else variant)
        done.where(F.col("variant") == variant).select("interview_id", "document").write.parquet(folder)
        one = readers.asr_segments(spark.read.parquet(folder)).select(F.col("interview_id").cast("bigint").alias("s_suppkey"), F.lit(folder[len(base) :]).alias("folder"), "start_ms", "end_ms", "text")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (
    render_turns, render_missing, render_files, render_report, manifest_rows, selected_ids, trash_round_trip, csv_round_trip, json_round_trip, log_round_trip, settings_round_trip, wav_samples, sizes_as_text, turn_ids,
    paragraph_fold_chunks, block_paragraphs, vtt_files, export_formats, download_progress, recogniser_variants,
)}

_C = B.COLLAPSE
_MAN = """base AS (SELECT conv_id, max(end_ms) AS e FROM seg GROUP BY conv_id),
man AS (
  SELECT conv_id, conv_id % 11 != 0 AS selected, CASE WHEN conv_id % 7 = 0 THEN '' ELSE printf('%d.%03d', (e + conv_id % 4 * 4000) // 1000, (e + conv_id % 4 * 4000) % 1000) END AS duration_sec FROM base
  UNION ALL SELECT conv_id + 1000000, true, '7.250' FROM base WHERE conv_id % 13 = 0)"""
_JOINED = _C.format("regexp_replace(p.text, ' ([,.;:!?%)])', '\\1', 'g')")
_CHAIN = f"""WITH RECURSIVE {B.SEG}, {B.SPAN}, {B.WORD}, {TR._BEST}, {TR._SEGMENT_BEST}, {_MAN},
h AS (SELECT w.*, coalesce(best.best_speaker, seg.speaker) AS who FROM word w JOIN seg USING (conv_id, idx) LEFT JOIN best USING (conv_id, idx, widx) WHERE w.end_ms > w.start_ms),
c AS (SELECT *, CASE WHEN lag(who) OVER (PARTITION BY conv_id, idx ORDER BY widx) = who THEN 0 ELSE 1 END AS fresh FROM h),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, idx ORDER BY widx) AS island FROM c),
p AS (SELECT conv_id, idx, island, min_by(start_ms, widx) AS start_ms, max_by(end_ms, widx) AS end_ms, min(who) AS speaker, string_agg(word, ' ' ORDER BY widx) AS text, max(island) OVER (PARTITION BY conv_id, idx) AS n FROM g GROUP BY conv_id, idx, island),
attr AS (
  SELECT p.conv_id, p.idx, p.island AS sub, p.start_ms, p.end_ms, p.speaker, {_JOINED} AS body, s.needs_review, '' AS note FROM p JOIN seg s USING (conv_id, idx) WHERE p.n > 1
  UNION ALL
  SELECT s.conv_id, s.idx, 0, s.start_ms, s.end_ms, coalesce(nullif(b.best_speaker, ''), s.speaker), {_C.format('s.text')}, s.needs_review OR coalesce(b.n_speakers > 1, false), CASE WHEN b.n_speakers > 1 THEN '{turns.MIXED_NOTE}' ELSE '' END
  FROM seg s LEFT JOIN seg_best b USING (conv_id, idx) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.conv_id = s.conv_id AND p.idx = s.idx AND p.n > 1)),
chosen AS (SELECT a.* FROM attr a JOIN man USING (conv_id) WHERE man.selected AND body != ''),
ranks AS (SELECT conv_id, speaker, row_number() OVER (PARTITION BY conv_id ORDER BY speaker) AS rank FROM (SELECT DISTINCT conv_id, speaker FROM chosen)),
s AS (SELECT c.*, CASE rank WHEN 1 THEN 'Entrevistador' WHEN 2 THEN 'Entrevistado' ELSE speaker END AS label, row_number() OVER (PARTITION BY conv_id ORDER BY idx, sub) AS rn FROM chosen c JOIN ranks USING (conv_id, speaker)),
walk AS (
  SELECT conv_id, rn, speaker, start_ms AS t0, end_ms AS prev_end, 0 AS turn FROM s WHERE rn = 1
  UNION ALL
  SELECT conv_id, rn, speaker, CASE WHEN stays THEN t0 ELSE start_ms END, end_ms, CASE WHEN stays THEN turn ELSE turn + 1 END
  FROM (SELECT s.*, w.t0, w.turn, s.speaker = w.speaker AND s.start_ms - w.prev_end <= 1800 AND s.end_ms - w.t0 <= 90000 AS stays FROM walk w JOIN s ON s.conv_id = w.conv_id AND s.rn = w.rn + 1)),
turns AS (
  SELECT s.conv_id, CAST(w.turn AS bigint) AS turn, min_by(s.start_ms, s.rn) AS start_ms, max_by(s.end_ms, s.rn) AS end_ms, min(s.speaker) AS speaker, min(s.label) AS human_label, string_agg(s.body, ' ' ORDER BY s.rn) AS text, count(*) AS segments,
    CASE WHEN min_by(s.needs_review, s.rn) THEN 'duvida' ELSE '' END AS flags, CASE WHEN min_by(s.needs_review, s.rn) THEN coalesce(nullif(min_by(s.note, s.rn), ''), 'Revisar falante.') ELSE '' END AS notes
  FROM walk w JOIN s USING (conv_id, rn) GROUP BY s.conv_id, w.turn)"""
_SEC = "CASE WHEN {0} IS NULL THEN '' ELSE CASE WHEN {0} < 0 THEN '-' ELSE '' END || printf('%d.%03d', abs({0}) // 1000, abs({0}) % 1000) END"
_REPORT = f"""{_CHAIN},
there AS (SELECT t.* FROM turns t WHERE conv_id % 5 != 0),
gaps AS (SELECT *, lag(coalesce(nullif(end_ms, 0), start_ms)) OVER o AS before, lag(start_ms, 1, -1000) OVER o AS previous FROM there WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
met AS (
  SELECT conv_id, count(*) AS turn_count, count(DISTINCT nullif(speaker, '')) AS speaker_count, count_if(end_ms - start_ms > 30000) AS long_turns, count_if(text = '') AS empty_turns, count_if(human_label = '' OR starts_with(human_label, 'SPEAKER_')) AS missing_human_labels,
    count_if(speaker IN ('', 'SPEAKER_UNKNOWN')) AS unknown_speakers, max(end_ms) AS last_ms, CASE WHEN count(*) > 1 THEN greatest(max(coalesce(nullif(start_ms, 0), before) - before), 0) END AS gap_ms, count_if(start_ms < previous) AS timestamp_regressions
  FROM gaps GROUP BY conv_id),
spoken AS (SELECT conv_id, max(ms) AS top_ms, sum(ms) AS total_ms FROM (SELECT conv_id, speaker, CAST(sum(greatest(end_ms - start_ms, 0)) AS bigint) AS ms FROM there GROUP BY ALL) GROUP BY conv_id),
raw AS (
  SELECT a.conv_id, a.n AS segs, a.blank, w.n AS words FROM (SELECT conv_id, count(*) AS n, count_if(coalesce(speaker, '') = '') AS blank FROM seg WHERE {_C.format('text')} != '' GROUP BY conv_id) a
  LEFT JOIN (SELECT word.conv_id, count(*) AS n FROM word JOIN seg USING (conv_id, idx) WHERE word.end_ms > word.start_ms AND {_C.format('seg.text')} != '' GROUP BY word.conv_id) w USING (conv_id)),
q AS (
  SELECT man.conv_id, man.duration_sec, met.* EXCLUDE (conv_id), met.conv_id IS NOT NULL AS has, top_ms, total_ms, CAST(round_even(try_cast(duration_sec AS double) * 1000, 0) AS bigint) AS dur, segs, blank, words, man.conv_id < 1000000 AS listed
  FROM man LEFT JOIN met USING (conv_id) LEFT JOIN spoken USING (conv_id) LEFT JOIN raw USING (conv_id) WHERE man.selected),
r AS (SELECT *, CASE WHEN last_ms != 0 THEN dur - last_ms END AS delta FROM q)
SELECT CAST(conv_id AS varchar) AS interview_id, CAST(has AS varchar) AS canonical_exists, CAST(listed AND conv_id % 4 != 0 AS varchar) AS raw_json_exists, CAST(listed AND conv_id % 3 != 0 AS varchar) AS wav_exists,
  CASE WHEN has THEN {_SEC.format('dur')} ELSE duration_sec END AS source_duration_sec, CAST(coalesce(turn_count, 0) AS varchar) AS turn_count, CAST(coalesce(speaker_count, 0) AS varchar) AS speaker_count,
  CASE WHEN total_ms > 0 THEN printf('%.3f', round_even(top_ms::double / total_ms::double, 3)) ELSE '' END AS speaker_time_ratio_max, CASE WHEN has THEN {_SEC.format('last_ms')} ELSE '0' END AS last_timestamp_sec, {_SEC.format('delta')} AS duration_delta_sec,
  CASE WHEN has AND dur > 0 THEN printf('%.4f', round_even(last_ms::double / dur::double, 4)) ELSE '' END AS coverage_ratio, {_SEC.format('gap_ms')} AS max_gap_sec, CAST(coalesce(long_turns, 0) AS varchar) AS long_turns, CAST(coalesce(empty_turns, 0) AS varchar) AS empty_turns,
  CAST(coalesce(timestamp_regressions, 0) AS varchar) AS timestamp_regressions, CAST(coalesce(unknown_speakers, 0) AS varchar) AS unknown_speakers, CAST(coalesce(missing_human_labels, 0) AS varchar) AS missing_human_labels,
  CASE WHEN has THEN CAST(segs AS varchar) ELSE '' END AS raw_segment_count, CASE WHEN has THEN CAST(blank AS varchar) ELSE '' END AS raw_segments_without_speaker, CASE WHEN has THEN CAST(coalesce(words, 0) AS varchar) ELSE '' END AS raw_word_count, '' AS raw_word_score_mean, '' AS raw_avg_logprob_mean,
  CAST(has AND conv_id % 2 != 0 AS varchar) AS diarization_regular_exists, CAST(has AND conv_id % 9 != 0 AS varchar) AS diarization_exclusive_exists,
  CASE WHEN NOT has THEN 'missing canonical JSON' ELSE concat_ws('; ', CASE WHEN speaker_count < 2 OR speaker_count > 2 THEN 'speaker_count_outside_expected_2_2' END, CASE WHEN abs(delta) > 10000 THEN 'duration_delta_gt_10s' END, CASE WHEN missing_human_labels > 0 THEN 'missing_human_labels' END,
    CASE WHEN timestamp_regressions > 0 THEN 'timestamp_regressions' END, CASE WHEN unknown_speakers > 0 THEN 'unknown_speakers' END) END AS notes
FROM r"""


def paragraphs_sql(source: str) -> str:
    """Common table expressions that end in ``para`` (gid, nth, paragraph); ``source`` selects gid, ci (from 0) and the collapsed text t."""
    return rf"""chunk AS ({source}),
ps AS (SELECT gid, s, ci > 0 AND i = 0 AS fresh, row_number() OVER (PARTITION BY gid ORDER BY ci, i) AS n FROM (SELECT gid, ci, unnest(x) AS s, unnest(range(len(x))) AS i FROM (SELECT gid, ci, {TR._SENTENCES} AS x FROM chunk WHERE t != '')) WHERE s != ''),
pw AS (
  SELECT DISTINCT gid, CAST(0 AS bigint) AS n, CAST('' AS varchar) AS cur, CAST(NULL AS varchar) AS out1, CAST(NULL AS varchar) AS out2 FROM chunk
  UNION ALL
  SELECT gid, n, CASE WHEN over THEN s WHEN len(cand) >= 850 AND regexp_matches(cand, '[.!?]$') THEN '' ELSE cand END, CASE WHEN closes THEN prev END, CASE WHEN over THEN kept WHEN len(cand) >= 850 AND regexp_matches(cand, '[.!?]$') THEN cand END
  FROM (SELECT *, kept != '' AND len(cand) > 1200 AS over FROM (SELECT *, CASE WHEN kept = '' THEN s ELSE kept || ' ' || s END AS cand FROM (SELECT *, CASE WHEN closes THEN '' ELSE prev END AS kept
    FROM (SELECT ps.*, pw.cur AS prev, ps.fresh AND len(pw.cur) >= 220 AS closes FROM pw JOIN ps ON ps.gid = pw.gid AND ps.n = pw.n + 1))))),
parts AS (SELECT gid, n, 1 AS k, out1 AS t FROM pw WHERE out1 IS NOT NULL UNION ALL SELECT gid, n, 2, out2 FROM pw WHERE out2 IS NOT NULL UNION ALL SELECT gid, 1000000000, 3, arg_max(cur, n) FROM pw GROUP BY gid HAVING arg_max(cur, n) != ''),
pn AS (SELECT gid, t, row_number() OVER (PARTITION BY gid ORDER BY n, k) - 1 AS nth, count(*) OVER (PARTITION BY gid) AS total FROM parts),
pz AS (SELECT pn.*, last.t AS tail FROM pn JOIN pn last ON last.gid = pn.gid AND last.nth = pn.total - 1),
para AS (SELECT gid, CAST(nth AS bigint) AS nth, CASE WHEN total >= 2 AND len(tail) < 220 AND nth = total - 2 THEN t || ' ' || tail ELSE t END AS paragraph FROM pz WHERE NOT (total >= 2 AND len(tail) < 220 AND nth = total - 1))"""


#: Blocks of the transcripts with their paragraphs, for use after WITH RECURSIVE.
BLOCK_PARAGRAPHS = TR._BLOCKS + ",\n" + paragraphs_sql("SELECT {'c': conv_id, 'b': block} AS gid, row_number() OVER (PARTITION BY conv_id, block ORDER BY turn) - 1 AS ci, body AS t FROM b2 WHERE body != ''")
_EXT = "CASE size % 5 WHEN 0 THEN '.mp4' WHEN 1 THEN '.wav' WHEN 2 THEN '.m4a' WHEN 3 THEN '.mov' ELSE '.ogg' END"
ORACLE = {
    "render_turns": f"{_CHAIN} SELECT * FROM turns",
    "render_missing": f"WITH {B.SEG}, {_MAN} SELECT conv_id, 'render' AS stage, 'missing recogniser document' AS status FROM man WHERE conv_id >= 1000000",
    "render_files": f"{_CHAIN}, {TR._cues(',').replace('-- ', '')} SELECT conv_id, 'srt' AS format, md5(string_agg(cue || chr(10) || times || chr(10) || text, chr(10) || chr(10) ORDER BY cue) || chr(10)) AS h FROM cues GROUP BY conv_id",
    "render_report": _REPORT,
    "selected_ids": f"WITH {B.SEG}, {_MAN} SELECT conv_id, duration_sec FROM man WHERE selected",
    "csv_round_trip": """SELECT CAST(c_custkey AS varchar) AS interview_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name || ', "' || c_mktsegment || '"' END AS title, CASE WHEN c_custkey % 2 = 0 THEN 'a' || chr(10) || 'é' ELSE '' END AS notes, '' AS more,
      row_number() OVER (ORDER BY c_custkey) AS place FROM customer""",
    "json_round_trip": "SELECT n_nationkey, n_nationkey % 5 = 0 AS corrupt, CASE WHEN n_nationkey % 5 != 0 THEN n_name END AS n_name, CASE WHEN n_nationkey % 5 != 0 THEN n_regionkey END AS n_regionkey FROM nation",
    "log_round_trip": f"WITH {B.EVENT} SELECT event_type AS stage, CASE WHEN dur_s % 4 = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n, CAST(sum(dur_s % 100) AS bigint) AS progress, 0 AS models FROM ev GROUP BY ALL",
    "settings_round_trip": """SELECT n_nationkey, name, value FROM (SELECT n_nationkey, unnest(['name', 'key', 'half', 'even', 'none', 'list', 'comment']) AS name,
      unnest([n_name || ': no 1', CAST(n_nationkey AS varchar), CAST(n_nationkey // 2 AS varchar) || CASE WHEN n_nationkey % 2 = 0 THEN '.0' ELSE '.5' END, CASE WHEN n_nationkey % 2 = 0 THEN 'True' ELSE 'False' END, 'null', '[' || chr(39) || n_name || chr(39) || ', ' || n_nationkey || ']', '5']) AS value FROM nation)""",
    "wav_samples": """WITH v AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, CAST(l_quantity AS int) * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) - 1 AS i, abs(CAST(l_quantity AS int)) AS v FROM lineitem),
      t AS (SELECT l_suppkey, i // 10 AS peak_idx, max(v) AS top FROM v GROUP BY ALL) SELECT l_suppkey, peak_idx, top::double / greatest(max(top) OVER (PARTITION BY l_suppkey), 1)::double AS peak, 8000 AS rate FROM t""",
    "sizes_as_text": """WITH s AS (SELECT o_orderkey AS k, o_orderkey * o_orderkey * [1, 37, 4099][o_orderkey % 3 + 1] AS n, o_orderkey % 9000 AS d FROM orders)
      SELECT k AS o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', n::double / 1024) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', n::double / 1048576) || ' MB' ELSE printf('%.2f', n::double / 1073741824) || ' GB' END AS size,
        CASE WHEN d >= 3600 THEN printf('%dh %02dmin', d // 3600, d // 60 % 60) ELSE printf('%dmin %02ds', d // 60, d % 60) END AS duration, strftime(make_timestamp(k * 7919 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS mtime FROM s""",
    "turn_ids": f"""WITH {B.SEG}, g AS (SELECT conv_id, idx, CASE WHEN idx % 3 = 0 THEN 'x_' || (idx % 4) END AS given FROM seg),
      f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx) - 1 AS pos, given IS NOT NULL AND row_number() OVER (PARTITION BY conv_id, given ORDER BY idx) = 1 AS kept FROM g)
      SELECT conv_id, pos, CASE WHEN kept THEN given ELSE printf('turn_%06d', CAST(sum(CASE WHEN kept THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY idx) AS bigint)) END AS turn_id, '' AS human_label, '' AS notes, false AS edited FROM f""",
    "paragraph_fold_chunks": "WITH RECURSIVE " + paragraphs_sql(f"SELECT doc_id AS gid, ci, {_C.format('line')} AS t FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS ci FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))") + " SELECT gid AS doc_id, nth, paragraph FROM para",
    "block_paragraphs": f"{BLOCK_PARAGRAPHS} SELECT CAST(gid.c AS bigint) AS conv_id, CAST(gid.b AS bigint) AS block, nth, paragraph FROM para",
    "vtt_files": f"{TR._TURNS}, {TR._cues('.')} SELECT conv_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(times || chr(10) || text, chr(10) || chr(10) ORDER BY cue) || chr(10) AS content FROM cues GROUP BY conv_id",
    "export_formats": f"{TR._TURNS}, n AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id) SELECT f AS format, conv_id, CASE WHEN f IN ('csv', 'tsv') THEN n ELSE 1 END AS n FROM (SELECT conv_id, n, unnest(['md', 'srt', 'vtt', 'csv', 'tsv']) AS f FROM n)",
    "download_progress": """WITH e AS (SELECT user_id, event_id, (CAST(floor(value) AS bigint) % 120) * 10 + event_id % 50 - 30 AS cur FROM events), p AS (SELECT *, 10 + CAST(floor(50 * least(100, CAST(floor(cur * 100 / 1000.0::double) AS bigint)) / 100.0::double) AS bigint) AS pct FROM e)
      SELECT user_id AS file_id, event_id AS seq, CAST(least(greatest(max(pct) OVER (PARTITION BY user_id ORDER BY event_id), 0), 60) AS bigint) AS shown FROM p""",
    "recogniser_variants": "SELECT s_suppkey, CASE v WHEN 'base' THEN '/usual' ELSE '/variants/big_model' END AS folder, 0 AS start_ms, 1500 AS end_ms, v || ' ' || s_suppkey AS text FROM (SELECT s_suppkey, unnest(['base', 'big model!']) AS v FROM supplier)",
    "trash_round_trip": """WITH k AS (SELECT *, c_custkey % 9 = 4 AS asked, c_custkey % 27 = 4 AS busy FROM customer),
      t AS (SELECT c_custkey AS id, asked AND NOT busy AS goes, unnest(['manifest', 'metadata', 'speakers_map', 'speakers_map', 'jobs']) AS name,
        unnest([c_name, c_mktsegment, 'SPEAKER_00', 'SPEAKER_01', CASE WHEN busy THEN 'Rodando 65' ELSE 'Transcrito 65' END]) AS detail FROM k),
      f AS (SELECT c_custkey AS id, unnest(['/p/json/' || c_custkey || '.canonical.json', '/p/wav/' || c_custkey || '.wav']) AS path FROM k WHERE asked AND NOT busy)
      SELECT 'left' AS what, name, id, detail FROM t WHERE NOT goes UNION ALL SELECT 'saved', name, id, detail FROM t WHERE goes
      UNION ALL SELECT 'back', name, id, CASE WHEN goes AND name = 'jobs' THEN 'Pendente 0' ELSE detail END FROM t
      UNION ALL SELECT 'moved', 'files', id, '/p/.trash/t1/files' || path FROM f UNION ALL SELECT 'gone', 'files', id, '/p/.trash/t1/files' || path FROM f
      UNION ALL SELECT CASE WHEN id % 2 = 0 THEN 'taken' ELSE 'copied' END, 'files', id, path FROM f
      UNION ALL SELECT 'entry', 't1', 0, 'purged' UNION ALL SELECT 'entry', 't2', 0, 'restored'""",
    "manifest_rows": rf"""WITH {L._F}, {L._N}, files AS (
        SELECT path, size FROM f WHERE size % 4 != 1 UNION ALL SELECT replace(path, 'File', 'B01R_'), size FROM f WHERE size % 2 = 0),
      m AS (SELECT path, size, {_EXT} AS ext, regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '') AS stem FROM files),
      x AS (SELECT *, coalesce(nullif(upper(regexp_extract(stem, '(?i)^([A-Z]\d{{2}}[RP]_\d{{4}})', 1)), ''), stem) AS id, CASE WHEN ext IN ('.mp4', '.mov') THEN 'V' ELSE 'AUDIO' END AS kind FROM m WHERE ext != '.ogg'),
      r AS (SELECT *, row_number() OVER o AS nth, first_value(path) OVER o AS first FROM x WINDOW o AS (PARTITION BY id ORDER BY list_position(['A', 'AUDIO', 'V'], kind), coalesce(list_position(['.wav', '.m4a', '.mp3', '.flac', '.mp4', '.mov'], ext), 7), lower(regexp_extract(path, '[^/]*$')), path)),
      forms AS (SELECT upper(regexp_extract(stem, '(?i)^([A-Z]\d{{2}}[RP])_(\d{{4}})', 1)) AS code, min(path) AS p FROM i WHERE c_custkey % 2 = 0 GROUP BY 1)
      SELECT id AS interview_id, regexp_extract(path, '([^/]*)/[^/]*$', 1) AS person_folder, substr(path, 6) AS source_path, ext AS source_ext, kind AS source_kind, CAST(nth = 1 AS varchar) AS selected, CASE WHEN nth = 1 THEN '' ELSE substr(first, 6) END AS duplicate_of,
        CAST(size AS varchar) AS source_size_bytes, strftime(make_timestamp(size * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS source_mtime_utc, CASE WHEN nth = 1 AND stem LIKE 'File%' AND size % 5 != 1 THEN md5(path) ELSE '' END AS source_sha256,
        {", ".join("CASE WHEN stem LIKE 'File%' AND size % 3 = 0 THEN '" + ("ok" if c == "probe_status" else "1.500") + "' ELSE '' END AS " + c if c in ("duration_sec", "probe_status") else "'' AS " + c for c in PROBE_COLUMNS)},
        CASE WHEN nth = 1 THEN 'wav/' || id || '.wav' ELSE '' END AS wav_path, CAST(p IS NOT NULL AS varchar) AS has_tcle, coalesce(p, '') AS tcle_path, CASE WHEN nth = 1 THEN 'pending' ELSE 'duplicate' END AS status, '' AS notes
      FROM r LEFT JOIN forms ON forms.code = upper(split_part(id, '_', 1)) AND forms.code != ''""",
}
ORACLE = {k: v.replace("AS string)", "AS varchar)") for k, v in ORACLE.items()}
assert len(QC_COLUMNS) == 25 and len(MANIFEST_COLUMNS) == 30
