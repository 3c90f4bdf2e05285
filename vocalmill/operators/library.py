"""The media library: manifest (S1, S2, J5, J7, W9, O1), lists (J6, O2-O5, P34-P36), counts (A9, A10), sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import text as X
from ..schemas import MANIFEST_COLUMNS, PROBE_COLUMNS

KIND_PREFERENCE = ("A", "AUDIO", "V")
EXTENSION_PREFERENCE = (".wav", ".m4a", ".mp3", ".flac", ".mp4", ".mov")


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row for each key, the first in order.  (Dropping duplicates would not keep to an order.)"""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")


def discover(listings: list[DataFrame], extensions: tuple[str, ...]) -> DataFrame:
    """Files of several listings (path, size, mtime), earlier listings first, each path once."""
    every = None
    for k, listing in enumerate(listings):
        one = listing.select("path", "size", "mtime", F.lit(k).alias("source_prio"))
        every = one if every is None else every.unionByName(one)
    media = every.where(M.extension(F.col("path")).isin(*extensions))
    return first_by(media, ["path"], "source_prio").withColumns({"interview_id": M.media_id(F.col("path")), "source_kind": M.media_kind(F.col("path")), "source_ext": M.extension(F.col("path"))})


def consents(paths: DataFrame) -> DataFrame:
    """(code, tcle_path): for each code its first consent form by path."""
    code = F.upper(F.regexp_extract(M.stem(F.col("path")), M.CONSENT_ID, 1))
    return first_by(paths.select(code.alias("code"), F.col("path").alias("tcle_path")).where("code != ''"), ["code"], "tcle_path")


def _rank(column: Column, preference: tuple[str, ...]) -> Column:
    at = F.array_position(F.array(*map(F.lit, preference)), column)
    return F.when(at > 0, at).otherwise(F.lit(len(preference) + 1))


def select_preferred(files: DataFrame, key: str = "interview_id", kinds: tuple[str, ...] = KIND_PREFERENCE, extensions: tuple[str, ...] = EXTENSION_PREFERENCE) -> DataFrame:
    """Of each recording's files one is selected: by kind, extension, name, then path; the others point to it."""
    window = Window.partitionBy(key).orderBy(_rank(F.col("source_kind"), kinds), _rank(F.col("source_ext"), extensions), F.lower(M.file_name(F.col("path"))), "path")
    ranked = files.withColumn("choice", F.row_number().over(window)).withColumn("__first", F.first("path").over(window))
    chosen = F.col("choice") == 1
    return ranked.withColumns({"selected": chosen, "duplicate_of": F.when(chosen, F.lit("")).otherwise(F.col("__first")), "status": F.when(chosen, F.lit("pending")).otherwise(F.lit("duplicate"))}).drop("__first")


def with_consent(manifest: DataFrame, forms: DataFrame, key: str = "interview_id") -> DataFrame:
    """Whether each row's code has a consent form, and where."""
    joined = manifest.withColumn("code", M.code_part(F.col(key))).join(forms, "code", "left").drop("code")
    return joined.withColumns({"has_tcle": F.col("tcle_path").isNotNull(), "tcle_path": F.coalesce("tcle_path", F.lit(""))})


def selected_rows(rows: DataFrame, ids: list[str] | None = None, key: str = "interview_id") -> DataFrame:
    """Selected rows, of the given ids if there are any."""
    chosen = rows.where(F.lower(F.col("selected").cast("string")) == "true")
    return chosen.where(F.col(key).isin(list(ids))) if ids else chosen


def manifest_counts(rows: DataFrame) -> DataFrame:
    """Rows, selected ones and duplicates."""
    chosen = F.lower(F.col("selected").cast("string")) == "true"
    return rows.agg(F.count("*").alias("rows"), F.count_if(chosen).alias("selected"), F.count_if(~chosen).alias("duplicates"))


def artifact_flags(listing: DataFrame, rules: dict[str, str], key: str = "interview_id") -> DataFrame:
    """A column for each rule: whether a listed path of the recording matches it; ``{id}`` in a rule is the recording's id, exactly."""
    pairs = None
    for name, pattern in rules.items():
        before, _, after = pattern.partition("{id}")
        found = listing.select(F.regexp_extract("path", rf"(?:^|/){before}([^/]+?){after}$", 1).alias(key), F.lit(name).alias("artifact")).where(f"{key} != ''")
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs.groupBy(key).agg(*(F.coalesce(F.bool_or(F.col("artifact") == name), F.lit(False)).alias(name) for name in rules))


def status_view(manifest: DataFrame, artifacts: DataFrame, qc: DataFrame | None = None, key: str = "interview_id") -> DataFrame:
    """Each selected recording with its artifacts (false where unknown) and the notes of its last check."""
    flags = [c for c in artifacts.columns if c != key]
    out = selected_rows(manifest).join(artifacts, key, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in flags})
    if qc is None:
        return out.withColumn("qc_notes", F.lit(""))
    return out.join(qc.select(key, F.col("notes").alias("qc_notes")), key, "left").withColumn("qc_notes", F.coalesce("qc_notes", F.lit("")))


def friendly_state(running: Column, failed: Column, reviewed: Column, canonical: Column) -> Column:
    """The state a list shows."""
    return F.when(running, F.lit("running")).when(failed, F.lit("failed")).when(reviewed, F.lit("reviewed")).when(canonical, F.lit("ready")).otherwise(F.lit("pending"))


def filter_list(rows: DataFrame, state: str | None = None, query: str = "", key: str = "interview_id") -> DataFrame:
    """Rows of a state whose id or title contains a text, without regard to case."""
    wanted = query.strip()
    out = rows.where(F.col("state") == state) if state and state != "all" else rows
    holds = lambda c: F.contains(X.folded(F.coalesce(F.col(c).cast("string"), F.lit(""))), X.folded(F.lit(wanted)))
    return out.where(holds(key) | holds("title")) if wanted else out


def pending(rows: DataFrame) -> DataFrame:
    """Recordings that are neither transcribed nor reviewed."""
    return rows.where(~(F.col("canonical_exists") | F.col("review_exists")))


def target_ids(rows: DataFrame, key: str = "interview_id") -> DataFrame:
    """The ids an action applies to: checked ones, else visually selected ones, else the cursor's; in order of ``idx``."""
    some = rows.agg(F.coalesce(F.bool_or("checked"), F.lit(False)).alias("__c"), F.coalesce(F.bool_or("visual"), F.lit(False)).alias("__v"))
    chosen = F.when(F.col("__c"), F.col("checked")).when(F.col("__v"), F.col("visual")).otherwise(F.col("cursor"))
    return rows.join(F.broadcast(some)).where(chosen).select(key, "idx")  # one row of two flags


def manual_order(rows: DataFrame, order: DataFrame, key: str = "interview_id") -> DataFrame:
    """O3: rows with a position first, by position, the others after, by id; sorted by ranges, with ``position`` (null without one)."""
    joined = rows.join(order.select(key, "position"), key, "left")
    return joined.orderBy(F.col("position").asc_nulls_last(), key)


def merge_order(order: Column, present: Column) -> Column:
    """An order without what is gone, and with what is new at its end."""
    return F.concat(F.filter(order, lambda x: F.array_contains(present, x)), F.array_except(present, order))


def move(order: Column, item: Column, step: int, hidden: Column) -> Column:
    """An order with an item moved past its next visible neighbour (step 1 down, -1 up); unchanged where there is none."""
    shown = F.filter(order, lambda x: ~F.array_contains(hidden, x))
    here = F.array_position(shown, item)
    other = F.when((here > 0) & (here + step > 0), F.get(shown, (here - 1 + step).cast("int")))
    return F.when(other.isNull(), order).otherwise(F.transform(order, lambda x: F.when(x == item, other).when(x == other, item).otherwise(x)))


def recent(entries: DataFrame, existing: DataFrame, limit: int = 10) -> DataFrame:
    """The latest use of each path that still exists, newest first, up to a limit."""
    last = entries.groupBy("path").agg(F.max("used_at").alias("used_at")).join(existing.select("path").distinct(), "path", "left_semi")
    return last.orderBy(F.col("used_at").desc(), "path").limit(limit)


def sizes(files: DataFrame, by: str) -> DataFrame:
    """Bytes, files and the oldest time for each group."""
    return files.groupBy(by).agg(F.sum("size").alias("bytes"), F.count("*").alias("files"), F.min("mtime").alias("oldest"))


def toggle(values: Column, value: Column) -> Column:
    """A sorted set with a value added, or removed if it was there."""
    return F.array_sort(F.when(F.array_contains(values, value), F.array_except(values, F.array(value))).otherwise(F.array_union(values, F.array(value))))


def union_sets(a: Column, b: Column) -> Column:
    """A sorted union."""
    return F.array_sort(F.array_union(a, b))


def speaker_options(labels: DataFrame, turns: DataFrame) -> DataFrame:
    """Labels, then labels seen in turns; each once without regard to case, in order (label, prio, idx)."""
    every = labels.select("label", F.lit(0).alias("prio"), "idx").unionByName(turns.select("label", F.lit(1).alias("prio"), "idx")).where("trim(label) != ''")
    return first_by(every.withColumn("__folded", X.folded(F.col("label"))), ["__folded"], "prio", "idx").drop("__folded")


def build_manifest(listings: list[DataFrame], extensions: tuple[str, ...], forms: DataFrame | None = None, probes: DataFrame | None = None, hashes: DataFrame | None = None, root: str = "/", kinds: tuple[str, ...] = KIND_PREFERENCE, preferred: tuple[str, ...] = EXTENSION_PREFERENCE) -> DataFrame:
    """The manifest's 30 text columns for the media of several listings (path, size, mtime): S1, J7, W9, S2, J5, S9, P30, P31.

    ``forms`` are paths of consent forms, ``probes`` has path and the probe columns, ``hashes`` path and sha256, which
    the selected file of a recording shows.  Paths are shown below ``root``.  Rows are unordered; O1 is ``manifest_order``.
    """
    media = select_preferred(discover(listings, extensions), kinds=kinds, extensions=preferred)
    media = with_consent(media, consents(forms)) if forms is not None else media.withColumns({"has_tcle": F.lit(False), "tcle_path": F.lit("")})
    if probes is not None:
        media = media.join(probes.select("path", *PROBE_COLUMNS), "path", "left")
    if hashes is not None:
        media = media.join(hashes.select("path", F.col("sha256").alias("__sha")), "path", "left")
    chosen = F.col("selected")
    shown = lambda c: M.relative_path(c, root)
    probed = {c: F.coalesce(c, F.lit("")) if probes is not None else F.lit("") for c in PROBE_COLUMNS}
    values = {
        "interview_id": F.col("interview_id"),
        "person_folder": F.substring_index(F.substring_index("path", "/", -2), "/", 1),
        "source_path": shown(F.col("path")),
        "source_ext": F.col("source_ext"),
        "source_kind": F.col("source_kind"),
        "selected": chosen.cast("string"),
        "duplicate_of": shown(F.col("duplicate_of")),
        "source_size_bytes": F.col("size").cast("string"),
        "source_mtime_utc": M.iso_utc(F.col("mtime")),
        "source_sha256": F.when(chosen, F.coalesce("__sha", F.lit(""))).otherwise(F.lit("")) if hashes is not None else F.lit(""),
        **probed,
        "wav_path": F.when(chosen, F.concat(F.lit("wav/"), "interview_id", F.lit(".wav"))).otherwise(F.lit("")),
        "has_tcle": F.col("has_tcle").cast("string"),
        "tcle_path": shown(F.col("tcle_path")),
        "status": F.col("status"),
        "notes": F.lit(""),
    }
    return media.select(*(values[c].alias(c) for c in MANIFEST_COLUMNS), F.col("choice").alias("__choice"))


def manifest_order(manifest: DataFrame) -> DataFrame:
    """O1: the manifest's rows by recording, then by preference; sorted by ranges, so the result is ordered as a whole."""
    return manifest.orderBy("interview_id", "__choice").drop("__choice")
