"""Queries over the library: manifest, metadata, jobs, trash, lists, names, models; the driver's tables stand in for its files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import text as X
from ..functions import timecode as TC
from ..operators import jobs, library, models, progress, review, trash, waveform
from .bindings import EVENT, event_intervals, table

# Files of a customer's recording: one for each order; one text for both engines.
_FILES = """
  SELECT concat('C', CAST(o_custkey AS string), '_', CAST(o_custkey % 7 AS string)) AS interview_id, o_orderkey AS size,
    CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'V' ELSE 'AUDIO' END AS source_kind, CASE o_orderkey % 5 WHEN 0 THEN '.mp4' WHEN 1 THEN '.wav' WHEN 2 THEN '.m4a' WHEN 3 THEN '.mov' ELSE '.ogg' END AS source_ext,
    concat('/lib/', CAST(o_custkey % 3 AS string), '/File', CAST(o_orderkey AS string), CASE o_orderkey % 5 WHEN 0 THEN '.mp4' WHEN 1 THEN '.wav' WHEN 2 THEN '.m4a' WHEN 3 THEN '.mov' ELSE '.ogg' END) AS path
  FROM {0}"""
# Names of media files in several forms.
_NAMES = r"""
  SELECT c_custkey, concat('/media/p', CAST(c_custkey % 9 AS string), '/', CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE '' END, CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE 'B' END, lpad(CAST(c_custkey % 100 AS string), 2, '0'),
    CASE WHEN c_custkey % 3 = 0 THEN 'r' ELSE 'P' END, '_', lpad(CAST(c_custkey % 1231 AS string), 4, '0'), CASE c_custkey % 5 WHEN 0 THEN '_A' WHEN 1 THEN '_v' WHEN 2 THEN ' take 2' ELSE '' END,
    CASE c_custkey % 3 WHEN 0 THEN '.MP4' WHEN 1 THEN '.m4a' ELSE '.tar.wav' END) AS path
  FROM {0}"""
_JOBS = """
  SELECT c_custkey AS file_id, CASE c_custkey % 7 WHEN 0 THEN 'Na fila' WHEN 1 THEN 'Rodando' WHEN 2 THEN 'Falha' WHEN 3 THEN 'Cancelando' ELSE 'Transcrito' END AS status, 'old stage' AS stage, CAST(c_custkey % 90 AS int) AS progress,
    CASE WHEN c_custkey % 3 = 0 THEN 'old error' END AS last_error, concat('t', CAST(c_custkey AS string)) AS updated_at, CASE WHEN c_custkey % 2 = 0 THEN 'q' END AS queued_at, CASE WHEN c_custkey % 5 = 0 THEN 's' END AS started_at, 'f' AS finished_at
  FROM {0} WHERE c_custkey % 4 != 1"""
_META = """
  SELECT c_custkey AS file_id, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'pt' WHEN 2 THEN 'en' WHEN 3 THEN 'xx' WHEN 4 THEN 'auto' ELSE 'project' END AS language, CASE c_custkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'exact' WHEN 2 THEN 'range' ELSE '' END AS speaker_mode,
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_custkey % 4 AS string) END AS speaker_count, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '1' END AS min_speakers, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '3' END AS max_speakers,
    CASE WHEN c_custkey % 2 = 0 THEN ' Ana | |Rui' ELSE '' END AS speaker_labels, CASE c_custkey % 3 WHEN 0 THEN 'custom' WHEN 1 THEN 'project' ELSE 'empty' END AS context_mode, CASE WHEN c_custkey % 2 = 0 THEN c_comment_like ELSE '' END AS context_text,
    CASE WHEN c_custkey % 4 < 2 THEN 'true' ELSE 'false' END AS use_context_as_prompt
  FROM (SELECT c_custkey, concat('ctx  ', c_name) AS c_comment_like FROM {0}) q"""


def _sql(spark, text, d, name, **more):
    return spark.sql(text.format("{t}"), t=table(spark, d, name), **more)


def _files(spark, d):
    return _sql(spark, _FILES, d, "orders")


def manifest_select(spark, d):
    m = library.select_preferred(_files(spark, d))
    return m.select("interview_id", "path", F.col("choice").cast("bigint").alias("choice"), "selected", "duplicate_of", "status")


def manifest_counts(spark, d):
    return library.manifest_counts(library.select_preferred(_files(spark, d)))


def media_key_parse(spark, d):
    p = F.col("path")
    return _sql(spark, _NAMES, d, "customer").select("c_custkey", M.media_id(p).alias("interview_id"), M.media_kind(p).alias("kind"), M.extension(p).alias("ext"), M.code_part(M.media_id(p)).alias("code"), M.media_label(M.extension(p), F.col("c_custkey") % 2 == 0).alias("label"), M.relative_path(p, "/media").alias("relative"))


def consent_left_join(spark, d):
    forms = library.consents(_sql(spark, _NAMES, d, "customer").where("c_custkey % 2 = 0"))
    rows = _sql(spark, _NAMES, d, "customer").select("c_custkey", M.media_id(F.col("path")).alias("interview_id"))
    return library.with_consent(rows, forms).select("c_custkey", "interview_id", "has_tcle", "tcle_path")


def discover_sources(spark, d):
    f = _files(spark, d).selectExpr("path", "size", "size AS mtime")
    found = library.discover([f.where("size % 4 = 0"), f.where("size % 3 = 0"), f.where("size % 2 = 0")], (".wav", ".m4a", ".mp4", ".mov"))
    return found.select("path", F.col("source_prio").cast("bigint").alias("source_prio"), "interview_id")


def metadata_upsert(spark, d):
    manifest = table(spark, d, "customer").where("c_custkey % 3 != 2").selectExpr("c_custkey AS file_id", "c_name AS source_path")
    previous = table(spark, d, "customer").where("c_custkey % 3 != 1").selectExpr("c_custkey AS file_id", "CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'fr' END AS language", "CASE WHEN c_custkey % 5 = 0 THEN 'mine' ELSE '' END AS title", "'old' AS source_path")
    return jobs.sync_metadata(manifest, previous, {"title": "{key}", "language": "auto"}, ("source_path",))


def update_upsert(spark, d):
    base = table(spark, d, "supplier").where("s_suppkey % 3 != 0").selectExpr("s_suppkey AS file_id", "s_name AS title", "'n' AS notes")
    new = table(spark, d, "supplier").where("s_suppkey % 2 = 0").selectExpr("s_suppkey AS file_id", "CASE WHEN s_suppkey % 4 = 0 THEN 'new' END AS title")
    return jobs.upsert(base, new, "file_id", ("title",))


def _derived(spark, d):
    k = F.col("c_custkey")
    state = jobs.from_artifacts(k % 11 == 0, k % 5 == 0, k % 3 == 0, k % 2 == 0)
    return table(spark, d, "customer").select(k.alias("file_id"), state.alias("s")).select("file_id", "s.*", F.lit("now").alias("now"))


def job_status(spark, d):
    return _derived(spark, d).select("file_id", "status", "stage", F.col("progress").cast("bigint").alias("progress"))


def job_sync(spark, d):
    return jobs.sync(_derived(spark, d), _sql(spark, _JOBS, d, "customer")).withColumn("progress", F.col("progress").cast("bigint"))


def busy_jobs(spark, d):
    return jobs.busy(_sql(spark, _JOBS, d, "customer"))


def _tables(spark, d):
    customer = table(spark, d, "customer")
    return {
        "manifest": customer.selectExpr("c_custkey AS interview_id", "c_name AS source_path"),
        "metadata": customer.selectExpr("c_custkey AS file_id", "c_mktsegment AS title"),
        "speakers_map": customer.selectExpr("c_custkey AS interview_id", "explode(array('SPEAKER_00', 'SPEAKER_01')) AS speaker_label"),
        "jobs": customer.selectExpr("c_custkey AS file_id", "'Transcrito' AS status", "CAST(65 AS int) AS progress"),
    }


def _ids(spark, d):
    return table(spark, d, "customer").where("c_custkey % 9 = 4").selectExpr("c_custkey AS id")


def _counts(tables):
    out = None
    for name, df in sorted(tables.items()):
        key = trash.KEYS[name][0]
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.coalesce(F.sum(key), F.lit(0)).cast("bigint").alias("s"))
        out = one if out is None else out.unionByName(one)
    return out


def snapshot_semi(spark, d):
    return _counts(trash.snapshot(_tables(spark, d), _ids(spark, d)))


def remove_anti(spark, d):
    return _counts(trash.remove(_tables(spark, d), _ids(spark, d)))


def restore_union(spark, d):
    tables, ids = _tables(spark, d), _ids(spark, d)
    return trash.restore(trash.remove(tables, ids), trash.snapshot(tables, ids))["jobs"].select("file_id", "status", F.col("progress").cast("bigint").alias("progress"))


def restore_collisions(spark, d):
    files = _files(spark, d)
    moved = files.where("size % 4 = 0").selectExpr("path AS original_path", "size")
    return trash.collisions(moved, files.where("size % 6 = 0").selectExpr("path", "size + 1 AS size", "size AS mtime")).select("original_path", "size", "size_now")


def stale_tables(spark, d):
    files = _files(spark, d).selectExpr("path", "CAST(size AS double) AS mtime")
    return trash.stale(files, files.withColumn("mtime", F.col("mtime") + F.pmod(F.col("mtime"), F.lit(3.0)))).select("path")


def manual_order(spark, d):
    rows = table(spark, d, "supplier").selectExpr("s_suppkey AS interview_id")
    order = rows.where("interview_id % 3 = 0").selectExpr("interview_id", "1000 - interview_id AS position")
    return library.manual_order(rows, order)


def order_moves(spark, d):
    g = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.col("n_nationkey").cast("bigint"))).alias("o"))
    hidden = F.filter("o", lambda x: x % 4 == 1)
    return g.select(
        "n_regionkey",
        F.array_join(library.move(F.col("o"), F.get("o", F.lit(2)), 1, hidden), ",").alias("down"),
        F.array_join(library.move(F.col("o"), F.get("o", F.lit(0)), -1, hidden), ",").alias("up"),
        F.array_join(library.merge_order(F.reverse("o"), F.array_union(F.filter("o", lambda x: x % 2 == 0), F.array(F.lit(100).cast("bigint")))), ",").alias("merged"),
    )


def _list(spark, d):
    k = F.col("c_custkey")
    state = library.friendly_state(k % 13 == 0, k % 11 == 0, k % 5 == 0, k % 3 == 0)
    return table(spark, d, "customer").select(F.concat(F.lit("Rec-"), k.cast("string")).alias("interview_id"), F.col("c_name").alias("title"), state.alias("state"), (k % 3 == 0).alias("canonical_exists"), (k % 5 == 0).alias("review_exists"))


def library_filter(spark, d):
    return library.filter_list(_list(spark, d), "ready", "R#00000012").select("interview_id", "title", "state")


def pending_ids(spark, d):
    return library.pending(_list(spark, d)).select("interview_id")


def target_ids(spark, d):
    rows = table(spark, d, "supplier").selectExpr("s_suppkey AS interview_id", "s_suppkey AS idx", "s_suppkey = -1 AS checked", "s_suppkey % 10 = 3 AS visual", "s_suppkey = 5 AS cursor")
    return library.target_ids(rows)


def status_view(spark, d):
    rows = table(spark, d, "customer").selectExpr("CAST(c_custkey AS string) AS interview_id", "CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS selected")
    listing = table(spark, d, "customer").selectExpr("explode(filter(array(CASE WHEN c_custkey % 3 = 0 THEN concat('/p/json/', c_custkey, '.canonical.json') END, CASE WHEN c_custkey % 4 = 0 THEN concat('/p/edits/', c_custkey, '.review.json') END), x -> x IS NOT NULL)) AS path")
    found = library.artifact_flags(listing, {"canonical_exists": r"json/{id}\.canonical\.json", "review_exists": r"edits/{id}\.review\.json"})
    qc = rows.where("CAST(interview_id AS bigint) % 5 = 0").selectExpr("interview_id", "'checked' AS notes")
    return library.status_view(rows, found, qc)


def recent_top10(spark, d):
    o = table(spark, d, "orders").selectExpr("concat('/p/', o_custkey) AS path", "o_orderkey AS used_at", "o_custkey")
    return library.recent(o.select("path", "used_at"), o.where("o_custkey % 2 = 0").select("path"))


def sizes_by_group(spark, d):
    return library.sizes(_files(spark, d).selectExpr("source_ext", "size", "size AS mtime"), "source_ext")


def flag_set_ops(spark, d):
    words = F.array_distinct(F.split("l_comment_like", " "))
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "concat_ws(' ', l_returnflag, l_linestatus, CAST(l_linenumber AS string)) AS l_comment_like")
    return rows.select("l_orderkey", "l_linenumber", F.array_join(library.toggle(words, F.lit("A")), ",").alias("toggled"), F.array_join(library.union_sets(words, F.array(F.lit("N"), F.lit("AIR"))), ",").alias("united"))


def speaker_options(spark, d):
    labels = table(spark, d, "nation").selectExpr("n_name AS label", "n_nationkey AS idx")
    seen = table(spark, d, "customer").selectExpr("CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE 'france' END AS label", "c_custkey AS idx")
    return library.speaker_options(labels, seen).select("label", F.col("prio").cast("bigint").alias("prio"))


def latest_job_state(spark, d):
    ev = event_intervals(spark, d).selectExpr("user_id AS file_id", "start_s AS updated_at", "event_id AS seq", "event_type AS status", "dur_s AS progress")
    return jobs.latest(ev)


def stage_failure_counts(spark, d):
    ev = event_intervals(spark, d).selectExpr("event_type AS stage", "CASE WHEN dur_s % 4 = 0 THEN 'failed' ELSE 'ok' END AS status")
    return jobs.stage_counts(ev)


def progress_ranges(spark, d):
    steps = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.sum(F.col("l_quantity").cast("bigint")) - 1).alias("weight"))
    out = progress.ranges(steps, ["l_orderkey"], "l_linenumber")
    return out.select("l_orderkey", "l_linenumber", F.col("start_percent").cast("bigint").alias("start_percent"), F.col("end_percent").cast("bigint").alias("end_percent"), progress.overall(F.col("start_percent"), F.col("end_percent"), F.col("weight")).cast("bigint").alias("overall"))


def monotone_progress(spark, d):
    ev = event_intervals(spark, d).selectExpr("event_id", "user_id", "event_id AS seq", "dur_s % 120 AS progress")
    return progress.monotone(ev, ["user_id"], "seq", cap=90).select("event_id", F.col("shown").cast("bigint").alias("shown"))


def waveform_peaks(spark, d):
    samples = table(spark, d, "lineitem").selectExpr("l_suppkey AS file_id", "l_orderkey AS idx", "CAST(l_quantity * (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) AS double) AS value")
    return waveform.peaks(samples, "file_id", 1000)


def waveform_level(spark, d):
    values = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x.l_quantity.cast("double")).alias("p"))
    n = F.size("p").cast("double")
    return values.select("l_orderkey", F.round(waveform.level(F.col("p"), n, F.lit(0.5), F.lit(1.25)), 6).alias("near"), waveform.level(F.col("p"), n, F.lit(0.0), n).alias("whole"))


def model_cache_status(spark, d):
    registry = table(spark, d, "region").selectExpr("lower(r_name) AS name", "concat('own/', lower(r_name)) AS repo", "r_regionkey % 2 = 0 AS required", "CAST(r_regionkey * 20 AS bigint) AS expected_bytes")
    return models.model_status(registry, _cache(spark, d)).select("name", "bytes", "files", "state")


def _cache(spark, d):
    files = table(spark, d, "nation").selectExpr("concat('/hub/models--own--', CASE n_regionkey WHEN 0 THEN 'africa' WHEN 1 THEN 'america' WHEN 2 THEN 'asia' ELSE 'other' END, '/blobs/', n_nationkey, CASE WHEN n_nationkey = 2 THEN '.incomplete' ELSE '' END) AS path", "CAST(n_nationkey AS bigint) AS size")
    return models.cache_repos(files)


def model_orphans(spark, d):
    registry = table(spark, d, "region").selectExpr("concat('own/', lower(r_name)) AS repo")
    return models.orphans(registry, _cache(spark, d)).select("repo", "bytes", "files")


def redact_secrets(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("t=hf_"), F.regexp_replace(F.left("text", F.lit(40)), "[^A-Za-z0-9]", ""), F.lit(" "), "text").alias("t"))
    return docs.select("doc_id", F.md5(X.redact(F.col("t"))).alias("h"))


def text_cleaning(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(X.collapse(t)).alias("collapsed"), F.size(X.sentences(X.collapse(t))).cast("bigint").alias("n_sentences"), X.preview(t).alias("preview"), X.cue_safe(F.concat(F.lit("a --> "), t)).alias("cue"), X.tail(t, 20).alias("tail"))


def safe_names(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.safe_name(t).alias("safe"), X.is_safe_id(F.col("source")).alias("is_safe"), X.title(t, 10)["title"].alias("title"))


def times_as_text(spark, d):
    ms = F.expr("l_orderkey * 37 + l_linenumber * 91")
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", TC.clock(ms).alias("clock"), TC.timecode(ms).alias("code"), TC.truncated_clock(ms / 1000).alias("cut"), TC.seconds_text(ms).alias("seconds"), TC.parse_timecode(TC.timecode(ms)).alias("back"), TC.eta_text(F.col("l_orderkey").cast("double")).alias("eta"))


def message_percent(spark, d):
    m = F.concat(F.lit("step 3% then "), (F.col("l_orderkey") % 150).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(" %")).otherwise(F.lit(" of 7")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.progress_percent(m).cast("bigint").alias("percent"))


def metadata_display(spark, d):
    c = F.col
    shown = M.metadata_display(c("language"), c("speaker_mode"), c("speaker_count"), c("min_speakers"), c("max_speakers"), c("speaker_labels"), c("context_mode"), c("context_text"))
    return _sql(spark, _META, d, "customer").select("file_id", shown.alias("s")).select("file_id", "s.*")


def effective_config(spark, d):
    c = F.col
    own = M.effective_config({"asr_language": "pt", "min_speakers": 2, "max_speakers": 4}, c("language"), c("speaker_mode"), c("speaker_count"), c("min_speakers"), c("max_speakers"), c("use_context_as_prompt"), c("context_text"), c("speaker_labels"))
    s = _sql(spark, _META, d, "customer").select("file_id", own.alias("s"))
    return s.select("file_id", "s.asr_language", *(F.col(f"s.{n}").cast("bigint").alias(n) for n in ("num_speakers", "min_speakers", "max_speakers")), "s.asr_initial_prompt")


def next_turn_id(spark, d):
    ids = table(spark, d, "lineitem").selectExpr("l_orderkey", "CASE WHEN l_linenumber % 3 = 0 THEN 'x_9' ELSE concat('turn_', lpad(CAST(l_linenumber * 7 AS string), 6, '0')) END AS id")
    return ids.groupBy("l_orderkey").agg(review.next_turn_number(F.col("id")).alias("next"))


QUERIES = {f.__name__: f for f in (
    manifest_select, manifest_counts, media_key_parse, consent_left_join, discover_sources, metadata_upsert, update_upsert, job_status, job_sync, busy_jobs, snapshot_semi, remove_anti, restore_union, restore_collisions, stale_tables,
    manual_order, order_moves, library_filter, pending_ids, target_ids, status_view, recent_top10, sizes_by_group, flag_set_ops, speaker_options, latest_job_state, stage_failure_counts, progress_ranges, monotone_progress,
    waveform_peaks, waveform_level, model_cache_status, model_orphans, redact_secrets, text_cleaning, safe_names, times_as_text, message_percent, metadata_display, effective_config, next_turn_id,
)}

_F = "f AS (" + _FILES.format("orders") + ")"
_N = "n AS (" + _NAMES.format("customer") + r"), k AS (SELECT *, regexp_extract(path, '[^/]*$') AS file, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1') AS stem FROM n), i AS (SELECT *, coalesce(nullif(upper(regexp_extract(stem, '(?i)^([A-Z]\d{2}[RP]_\d{4})', 1)), ''), stem) AS id FROM k)"
_KIND = r"coalesce(nullif(upper(regexp_extract(stem, '(?i)^([A-Z]\d{2}[RP]_\d{4})(?:_(A|V))?', 2)), ''), CASE WHEN lower(path) LIKE '%.mp4' OR lower(path) LIKE '%.mov' THEN 'V' ELSE 'AUDIO' END)"
_EXT = r"lower(regexp_extract(file, '\.[^.]*$'))"
_RANKED = f"{_F}, r AS (SELECT *, row_number() OVER w AS choice, first_value(path) OVER w AS first FROM f WINDOW w AS (PARTITION BY interview_id ORDER BY list_position(['A', 'AUDIO', 'V'], source_kind), coalesce(list_position(['.wav', '.m4a', '.mp3', '.flac', '.mp4', '.mov'], source_ext), 7), lower(regexp_extract(path, '[^/]*$')), path))"
_STATE = "CASE WHEN c_custkey % 11 = 0 THEN {0} WHEN c_custkey % 5 = 0 THEN {1} WHEN c_custkey % 3 = 0 THEN {2} WHEN c_custkey % 2 = 0 THEN {3} ELSE {4} END"
_DERIVED = "derived AS (SELECT c_custkey AS file_id, " + ", ".join(f"{_STATE.format(*v)} AS {n}" for n, v in (("status", ("'Pronto para revisar'", "'Falantes identificados'", "'Transcrito'", "'Áudio preparado'", "'Pendente'")), ("stage", ("'transcrição montada'", "'montar transcrição'", "'identificar falantes'", "'transcrever'", "'preparar áudio'")), ("progress", ("100", "82", "65", "20", "0")))) + " FROM customer)"
_J = "j AS (" + _JOBS.format("customer") + ")"
_M = "m AS (" + _META.format("customer") + ")"
_LIST = "l AS (SELECT 'Rec-' || c_custkey AS interview_id, c_name AS title, CASE WHEN c_custkey % 13 = 0 THEN 'running' WHEN c_custkey % 11 = 0 THEN 'failed' WHEN c_custkey % 5 = 0 THEN 'reviewed' WHEN c_custkey % 3 = 0 THEN 'ready' ELSE 'pending' END AS state, c_custkey FROM customer)"
_SUMS = "SELECT 'jobs' AS name, count(*) AS n, CAST(coalesce(sum(c_custkey), 0) AS bigint) AS s FROM customer WHERE {0} UNION ALL SELECT 'manifest', count(*), CAST(coalesce(sum(c_custkey), 0) AS bigint) FROM customer WHERE {0} UNION ALL SELECT 'metadata', count(*), CAST(coalesce(sum(c_custkey), 0) AS bigint) FROM customer WHERE {0} UNION ALL SELECT 'speakers_map', 2 * count(*), CAST(coalesce(2 * sum(c_custkey), 0) AS bigint) FROM customer WHERE {0}"
_CACHE = "files AS (SELECT 'own/' || CASE n_regionkey WHEN 0 THEN 'africa' WHEN 1 THEN 'america' WHEN 2 THEN 'asia' ELSE 'other' END AS repo, n_nationkey AS size FROM nation), cache AS (SELECT repo, CAST(sum(size) AS bigint) AS bytes, count(*) AS files, bool_or(size = 2) AS incomplete FROM files GROUP BY repo)"
_MS = "(l_orderkey * 37 + l_linenumber * 91)"
_CLOCKED = "printf('%02d:%02d:%02d', {0} // 3600, {0} // 60 % 60, {0} % 60)"

ORACLE = {
    "manifest_select": f"WITH {_RANKED} SELECT interview_id, path, choice, choice = 1 AS selected, CASE WHEN choice = 1 THEN '' ELSE first END AS duplicate_of, CASE WHEN choice = 1 THEN 'pending' ELSE 'duplicate' END AS status FROM r",
    "manifest_counts": f"WITH {_RANKED} SELECT count(*) AS rows, count_if(choice = 1) AS selected, count_if(choice != 1) AS duplicates FROM r",
    "media_key_parse": f"""WITH {_N} SELECT c_custkey, id AS interview_id, {_KIND} AS kind, {_EXT} AS ext, upper(split_part(id, '_', 1)) AS code,
      CASE WHEN {_EXT} IN ('.mov', '.mp4') THEN 'Vídeo ' ELSE 'Áudio ' END || upper(substr({_EXT}, 2)) || CASE WHEN c_custkey % 2 = 0 AND {_EXT} != '.wav' THEN ' (WAV pronto)' ELSE '' END AS label, substr(path, 8) AS relative FROM i""",
    "consent_left_join": rf"""WITH {_N}, forms AS (SELECT upper(regexp_extract(stem, '(?i)^([A-Z]\d{{2}}[RP])_(\d{{4}})', 1)) AS code, min(path) AS p FROM i WHERE c_custkey % 2 = 0 GROUP BY 1)
      SELECT c_custkey, id AS interview_id, p IS NOT NULL AS has_tcle, coalesce(p, '') AS tcle_path FROM i LEFT JOIN forms ON forms.code = upper(split_part(id, '_', 1)) AND forms.code != ''""",
    "discover_sources": rf"""WITH {_F} SELECT path, CASE WHEN size % 4 = 0 THEN 0 WHEN size % 3 = 0 THEN 1 ELSE 2 END AS source_prio, regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '') AS interview_id
      FROM f WHERE (size % 4 = 0 OR size % 3 = 0 OR size % 2 = 0) AND source_ext IN ('.wav', '.m4a', '.mp4', '.mov')""",
    "metadata_upsert": """SELECT c.c_custkey AS file_id, c.c_name AS source_path, CASE WHEN c_custkey % 3 != 1 AND c_custkey % 5 = 0 THEN 'mine' ELSE CAST(c_custkey AS varchar) END AS title,
      CASE WHEN c_custkey % 3 != 1 AND c_custkey % 2 != 0 THEN 'fr' ELSE 'auto' END AS language FROM customer c WHERE c_custkey % 3 != 2""",
    "update_upsert": """SELECT s_suppkey AS file_id, CASE WHEN s_suppkey % 4 = 0 THEN 'new' WHEN s_suppkey % 3 != 0 THEN s_name END AS title, CASE WHEN s_suppkey % 3 != 0 THEN 'n' END AS notes FROM supplier WHERE s_suppkey % 3 != 0 OR s_suppkey % 2 = 0""",
    "job_status": f"WITH {_DERIVED} SELECT * FROM derived",
    "job_sync": f"""WITH {_DERIVED}, {_J}, x AS (SELECT d.*, j.status AS ps, j.stage AS pg, j.progress AS pp, j.last_error AS pe, j.updated_at AS pu, j.queued_at, j.started_at, j.finished_at AS pf, coalesce(j.status IN ('Na fila', 'Cancelando', 'Falha'), false) AS stays, coalesce(j.status = 'Rodando', false) AS stale FROM derived d LEFT JOIN j USING (file_id))
      SELECT file_id, CASE WHEN stays THEN ps ELSE status END AS status, CASE WHEN stays THEN pg ELSE stage END AS stage, CAST(CASE WHEN stays THEN pp ELSE progress END AS bigint) AS progress,
        CASE WHEN stays THEN pu WHEN stale THEN 'now' ELSE coalesce(pu, 'now') END AS updated_at, CASE WHEN stale THEN 'Tarefa interrompida (provável crash ou fechamento forçado).' ELSE coalesce(pe, '') END AS last_error, queued_at, started_at, CASE WHEN NOT stale THEN pf END AS finished_at FROM x""",
    "busy_jobs": f"WITH {_J} SELECT file_id FROM j WHERE status IN ('Na fila', 'Rodando', 'Cancelando')",
    "snapshot_semi": _SUMS.format("c_custkey % 9 = 4"),
    "remove_anti": _SUMS.format("c_custkey % 9 != 4"),
    "restore_union": "SELECT c_custkey AS file_id, CASE WHEN c_custkey % 9 = 4 THEN 'Pendente' ELSE 'Transcrito' END AS status, CASE WHEN c_custkey % 9 = 4 THEN 0 ELSE 65 END AS progress FROM customer",
    "restore_collisions": f"WITH {_F} SELECT path AS original_path, size, size + 1 AS size_now FROM f WHERE size % 4 = 0 AND size % 6 = 0",
    "stale_tables": f"WITH {_F} SELECT path FROM f WHERE size % 3 > 1",
    "manual_order": "SELECT s_suppkey AS interview_id, CASE WHEN s_suppkey % 3 = 0 THEN 1000 - s_suppkey END AS position FROM supplier",
    "order_moves": """WITH o AS (SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS o FROM nation GROUP BY n_regionkey),
      v AS (SELECT *, list_filter(o, lambda x: x % 4 != 1) AS shown FROM o),
      t AS (SELECT *, o[3] AS a, o[1] AS b, CASE WHEN list_position(shown, o[3]) > 0 THEN shown[list_position(shown, o[3]) + 1] END AS na, CASE WHEN list_position(shown, o[1]) > 1 THEN shown[list_position(shown, o[1]) - 1] END AS nb FROM v)
      SELECT n_regionkey, array_to_string(CASE WHEN na IS NULL THEN o ELSE list_transform(o, lambda x: CASE WHEN x = a THEN na WHEN x = na THEN a ELSE x END) END, ',') AS down,
        array_to_string(CASE WHEN nb IS NULL THEN o ELSE list_transform(o, lambda x: CASE WHEN x = b THEN nb WHEN x = nb THEN b ELSE x END) END, ',') AS up,
        array_to_string(list_concat(list_filter(list_reverse(o), lambda x: x % 2 = 0), [100]), ',') AS merged FROM t""",
    "library_filter": f"WITH {_LIST} SELECT interview_id, title, state FROM l WHERE state = 'ready' AND (lower(interview_id) LIKE '%r#00000012%' OR lower(title) LIKE '%r#00000012%')",
    "pending_ids": f"WITH {_LIST} SELECT interview_id FROM l WHERE c_custkey % 3 != 0 AND c_custkey % 5 != 0",
    "target_ids": "SELECT s_suppkey AS interview_id, s_suppkey AS idx FROM supplier WHERE s_suppkey % 10 = 3",
    "status_view": "SELECT CAST(c_custkey AS varchar) AS interview_id, 'true' AS selected, c_custkey % 3 = 0 AS canonical_exists, c_custkey % 4 = 0 AS review_exists, CASE WHEN c_custkey % 5 = 0 THEN 'checked' ELSE '' END AS qc_notes FROM customer WHERE c_custkey % 2 = 0",
    "recent_top10": "SELECT '/p/' || o_custkey AS path, max(o_orderkey) AS used_at FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey ORDER BY used_at DESC, path LIMIT 10",
    "sizes_by_group": f"WITH {_F} SELECT source_ext, CAST(sum(size) AS bigint) AS bytes, count(*) AS files, min(size) AS oldest FROM f GROUP BY source_ext",
    "flag_set_ops": """WITH w AS (SELECT l_orderkey, l_linenumber, list_distinct(string_split(l_returnflag || ' ' || l_linestatus || ' ' || l_linenumber, ' ')) AS w FROM lineitem)
      SELECT l_orderkey, l_linenumber, array_to_string(list_sort(CASE WHEN list_contains(w, 'A') THEN list_filter(w, lambda x: x != 'A') ELSE list_append(w, 'A') END), ',') AS toggled, array_to_string(list_sort(list_distinct(list_concat(w, ['N', 'AIR']))), ',') AS united FROM w""",
    "speaker_options": """WITH e AS (SELECT n_name AS label, 0 AS prio, n_nationkey AS idx FROM nation UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE 'france' END, 1, c_custkey FROM customer)
      SELECT label, CAST(prio AS bigint) AS prio FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(label)) ORDER BY prio, idx) AS nth FROM e) WHERE nth = 1""",
    "latest_job_state": f"WITH {EVENT} SELECT user_id AS file_id, start_s AS updated_at, event_id AS seq, event_type AS status, dur_s AS progress FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_s DESC, event_id DESC) AS nth FROM ev) WHERE nth = 1",
    "stage_failure_counts": f"WITH {EVENT} SELECT event_type AS stage, CASE WHEN dur_s % 4 = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n FROM ev GROUP BY ALL",
    "progress_ranges": """WITH s AS (SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS bigint)) AS bigint) - 1 AS w FROM lineitem GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY l_orderkey) AS total, sum(w) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS upto FROM s),
      p AS (SELECT l_orderkey, l_linenumber, w, CASE WHEN total = 0 THEN 0 ELSE CAST(floor((upto - w) * 100.0::double / total) AS bigint) END AS a, CASE WHEN total = 0 THEN 0 ELSE CAST(floor(upto * 100.0::double / total) AS bigint) END AS b FROM r)
      SELECT l_orderkey, l_linenumber, a AS start_percent, b AS end_percent, a + CAST(floor((b - a) * least(greatest(w, 0), 100) / 100.0::double) AS bigint) AS overall FROM p""",
    "monotone_progress": f"WITH {EVENT} SELECT event_id, CAST(least(max(dur_s % 120) OVER (PARTITION BY user_id ORDER BY event_id), 90) AS bigint) AS shown FROM ev",
    "waveform_peaks": """WITH e AS (SELECT l_suppkey AS file_id, l_orderkey // 1000 AS peak_idx, max(CAST(l_quantity AS double)) AS top FROM lineitem GROUP BY ALL) SELECT file_id, peak_idx, top / greatest(max(top) OVER (PARTITION BY file_id), 1) AS peak FROM e""",
    "waveform_level": """WITH v AS (SELECT l_orderkey, list(CAST(l_quantity AS double) ORDER BY l_linenumber, l_quantity) AS p FROM lineitem GROUP BY l_orderkey)
      SELECT l_orderkey, round(p[1] + (p[least(len(p), 2)] - p[1]) * 0.5, 6) AS near, CASE WHEN len(p) <= 2 THEN p[1] ELSE list_max(p) END AS whole FROM v""",
    "model_cache_status": f"WITH {_CACHE} SELECT lower(r_name) AS name, coalesce(bytes, 0) AS bytes, coalesce(files, 0) AS files, CASE WHEN files IS NULL THEN 'missing' WHEN incomplete OR bytes < r_regionkey * 20 THEN 'partial' ELSE 'ready' END AS state FROM region LEFT JOIN cache ON cache.repo = 'own/' || lower(r_name)",
    "model_orphans": f"WITH {_CACHE} SELECT repo, bytes, files FROM cache WHERE repo NOT IN (SELECT 'own/' || lower(r_name) FROM region)",
    "redact_secrets": "SELECT doc_id, md5(regexp_replace('t=hf_' || regexp_replace(left(text, 40), '[^A-Za-z0-9]', '', 'g') || ' ' || text, 'hf_[A-Za-z0-9]{8,}', 'hf_***', 'g')) AS h FROM documents",
    "text_cleaning": r"""WITH c AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, md5(t) AS collapsed, CAST(greatest(1, len(list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x != ''))) AS bigint) AS n_sentences, CASE WHEN len(t) <= 120 THEN t ELSE rtrim(left(t, 117)) || '...' END AS preview,
        trim(regexp_replace(replace('a --> ' || text, '-->', '->'), '[\r\n]+', ' ', 'g')) AS cue, right(text, 20) AS tail FROM c""",
    "safe_names": r"""SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'item') AS safe, regexp_full_match(source, '[A-Za-z0-9][A-Za-z0-9_.-]*') AND NOT contains(source, '..') AS is_safe,
      rtrim(left(trim(regexp_replace(text, '[\x00-\x1f]', '', 'g')), 10)) AS title FROM documents WHERE text IS NOT NULL""",
    "times_as_text": f"""SELECT l_orderkey, l_linenumber, {_CLOCKED.format(f'CAST(round_even({_MS} / 1000.0::double, 0) AS bigint)')} AS clock, printf('%02d:%02d:%02d.%03d', {_MS} // 3600000, {_MS} // 60000 % 60, {_MS} // 1000 % 60, {_MS} % 1000) AS code,
      {_CLOCKED.format(f'({_MS} // 1000)')} AS cut, printf('%d.%03d', {_MS} // 1000, {_MS} % 1000) AS seconds, ({_MS} // 60000 * 60) + CAST(printf('%02d.%03d', {_MS} // 1000 % 60, {_MS} % 1000) AS double) AS back,
      CASE WHEN l_orderkey <= 0 THEN 'estimando...' WHEN l_orderkey < 60 THEN printf('cerca de %ds', l_orderkey) WHEN l_orderkey < 3600 THEN printf('cerca de %dmin %02ds', l_orderkey // 60, l_orderkey % 60) ELSE printf('cerca de %dh %02dmin', l_orderkey // 3600, l_orderkey // 60 % 60) END AS eta FROM lineitem""",
    "message_percent": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN least(l_orderkey % 150, 100) ELSE 3 END AS percent FROM lineitem",
    "metadata_display": f"""WITH {_M}, c AS (SELECT *, coalesce(nullif(language, ''), 'auto') AS code FROM m) SELECT file_id, CASE code WHEN 'auto' THEN 'Automático' WHEN 'pt' THEN 'Português' WHEN 'en' THEN 'Inglês' ELSE code END AS language,
      CASE speaker_mode WHEN 'exact' THEN coalesce(nullif(speaker_count, ''), 'exato') WHEN 'range' THEN coalesce(nullif(min_speakers, ''), '?') || '-' || coalesce(nullif(max_speakers, ''), '?') ELSE 'Automático' END AS speakers,
      CASE WHEN speaker_labels = '' THEN 'Entrevistador, Entrevistado' ELSE 'Ana, Rui' END AS speaker_labels, CASE WHEN context_mode = 'custom' AND context_text != '' THEN 'Personalizado' WHEN context_mode = 'project' THEN 'Projeto' ELSE 'Vazio' END AS context FROM c""",
    "effective_config": rf"""WITH {_M}, c AS (SELECT *, coalesce(try_cast(speaker_count AS bigint), 2) AS cnt, coalesce(try_cast(min_speakers AS bigint), 2) AS lo, coalesce(try_cast(max_speakers AS bigint), 4) AS hi FROM m)
      SELECT file_id, CASE WHEN language IN ('', 'project') THEN 'pt' WHEN language != 'auto' THEN language END AS asr_language, CASE WHEN speaker_mode = 'exact' THEN cnt END AS num_speakers,
      CASE speaker_mode WHEN 'auto' THEN NULL WHEN 'exact' THEN cnt WHEN 'range' THEN lo ELSE 2 END AS min_speakers, CASE speaker_mode WHEN 'auto' THEN NULL WHEN 'exact' THEN cnt WHEN 'range' THEN hi ELSE 4 END AS max_speakers,
      CASE WHEN use_context_as_prompt = 'true' AND context_text != '' THEN trim(regexp_replace(context_text, '\s+', ' ', 'g')) END AS asr_initial_prompt FROM c""",
    "next_turn_id": "SELECT l_orderkey, coalesce(max(CASE WHEN l_linenumber % 3 != 0 THEN l_linenumber * 7 END), 0) + 1 AS next FROM lineitem GROUP BY l_orderkey",
}
ORACLE = {k: v.replace("AS string)", "AS varchar)") for k, v in ORACLE.items()}
