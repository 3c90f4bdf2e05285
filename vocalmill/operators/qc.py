"""Quality metrics of recordings (A1-A8, W1, W2).  One shuffle on the recording's id serves all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.timecode import seconds_text
from ..schemas import QC_COLUMNS


def _end(column: str = "end_ms") -> Column:
    return F.coalesce(column, F.lit(0))


def turn_metrics(turns: DataFrame, key: str = "interview_id", max_turn_ms: int = 90000) -> DataFrame:
    """A1-A3, W1, W2 per recording: counts, last timestamp, greatest gap (null for one turn), regressions."""
    order = Window.partitionBy(key).orderBy("turn")
    start = F.coalesce("start_ms", F.lit(0))
    # the end of the turn before: its own, or where it has none its start, or the end before that
    rows = turns.withColumn("__start", start).withColumn("__before", F.lag(F.coalesce(F.nullif("end_ms", F.lit(0)), "start_ms", F.lit(0))).over(order))
    rows = rows.withColumn("__previous", F.lag("__start", 1, -1000).over(order))
    gap = F.coalesce(F.nullif("start_ms", F.lit(0)), "__before") - F.col("__before")
    label = F.coalesce("human_label", F.lit(""))
    speaker = F.trim(F.coalesce("speaker", F.lit("")))
    return rows.groupBy(key).agg(
        F.count("*").alias("turn_count"),
        F.count_distinct(X.blank_to_null(F.col("speaker"))).alias("speaker_count"),
        F.count_if(_end() - F.col("__start") > max_turn_ms).alias("long_turns"),
        F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty_turns"),
        F.count_if((label == "") | label.startswith("SPEAKER_")).alias("missing_human_labels"),
        F.count_if((speaker == "") | (speaker == "SPEAKER_UNKNOWN")).alias("unknown_speakers"),
        F.coalesce(F.max(_end()), F.lit(0)).alias("last_ms"),
        F.when(F.count("*") > 1, F.greatest(F.max(gap), F.lit(0))).alias("max_gap_ms"),
        F.count_if(F.col("__start") < F.col("__previous")).alias("timestamp_regressions"),
    )


def speaker_time(turns: DataFrame, key: str = "interview_id") -> DataFrame:
    """A5: time of the most talkative speaker and of all, in milliseconds; an empty speaker is one of its own."""
    spoken = F.greatest(_end() - F.coalesce("start_ms", F.lit(0)), F.lit(0))
    each = turns.groupBy(key, F.coalesce("speaker", F.lit("")).alias("speaker")).agg(F.sum(spoken).alias("ms"))
    return each.groupBy(key).agg(F.max("ms").alias("top_ms"), F.sum("ms").alias("total_ms"))


def recording_metrics(turns: DataFrame, key: str = "interview_id", max_turn_ms: int = 90000) -> DataFrame:
    """The columns of :func:`turn_metrics` and :func:`speaker_time` in one pass, with one shuffle.

    Rows are added up by speaker first, in the windows' partitioning, then by recording.
    """
    order = Window.partitionBy(key).orderBy("turn")
    start = F.coalesce("start_ms", F.lit(0))
    before = F.lag(F.coalesce(F.nullif("end_ms", F.lit(0)), "start_ms", F.lit(0))).over(order)
    rows = turns.select(key, "turn", "start_ms", "end_ms", "speaker", "human_label", "text", start.alias("__start"), before.alias("__before"), F.lag(start, 1, -1000).over(order).alias("__previous"))
    gap = F.coalesce(F.nullif("start_ms", F.lit(0)), "__before") - F.col("__before")
    label, speaker = F.coalesce("human_label", F.lit("")), F.trim(F.coalesce("speaker", F.lit("")))
    each = rows.groupBy(key, F.coalesce("speaker", F.lit("")).alias("__who")).agg(
        F.count("*").alias("turn_count"),
        F.count_if(_end() - F.col("__start") > max_turn_ms).alias("long_turns"),
        F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty_turns"),
        F.count_if((label == "") | label.startswith("SPEAKER_")).alias("missing_human_labels"),
        F.count_if((speaker == "") | (speaker == "SPEAKER_UNKNOWN")).alias("unknown_speakers"),
        F.count_if(F.col("__start") < F.col("__previous")).alias("timestamp_regressions"),
        F.max(_end()).alias("last_ms"),
        F.max(gap).alias("gap_ms"),
        F.sum(F.greatest(_end() - F.col("__start"), F.lit(0))).alias("ms"),
    )
    added = ["turn_count", "long_turns", "empty_turns", "missing_human_labels", "unknown_speakers", "timestamp_regressions"]
    return each.groupBy(key).agg(
        *(F.sum(c).alias(c) for c in added),
        F.count_if(X.blank_to_null(F.col("__who")).isNotNull()).alias("speaker_count"),
        F.coalesce(F.max("last_ms"), F.lit(0)).alias("last_ms"),
        F.when(F.sum("turn_count") > 1, F.greatest(F.max("gap_ms"), F.lit(0))).alias("max_gap_ms"),
        F.max("ms").alias("top_ms"),
        F.sum("ms").alias("total_ms"),
    )


def raw_metrics(segments: DataFrame, words: DataFrame, key: str = "interview_id") -> DataFrame:
    """Segments, segments without speaker, words, mean word score, mean log-probability of a recording's raw output."""
    by_segment = segments.groupBy(key).agg(F.count("*").alias("raw_segment_count"), F.count_if(F.coalesce("speaker", F.lit("")) == "").alias("raw_segments_without_speaker"), F.avg("avg_logprob").alias("raw_avg_logprob_mean"))
    by_word = words.groupBy(key).agg(F.count("*").alias("raw_word_count"), F.avg("score").alias("raw_word_score_mean"))
    return by_segment.join(by_word, key, "left").withColumn("raw_word_count", F.coalesce("raw_word_count", F.lit(0)))


def notes(speaker_count: Column, delta_ms: Column, missing_labels: Column, regressions: Column, unknown: Column, expected: tuple[int, int] = (2, 2)) -> Column:
    """Names of the broken rules, in a fixed order."""
    low, high = expected

    def rule(broken: Column, name: str) -> Column:
        return F.when(broken, F.lit(name))

    return F.concat_ws(
        "; ",
        rule((speaker_count < low) | (speaker_count > high), f"speaker_count_outside_expected_{low}_{high}"),
        rule(F.abs(delta_ms) > 10000, "duration_delta_gt_10s"),
        rule(missing_labels > 0, "missing_human_labels"),
        rule(regressions > 0, "timestamp_regressions"),
        rule(unknown > 0, "unknown_speakers"),
    )


def metrics(turns: DataFrame, recordings: DataFrame, key: str = "interview_id", max_turn_ms: int = 90000, expected: tuple[int, int] = (2, 2)) -> DataFrame:
    """A row for each of ``recordings`` (key, duration_ms or null); those without turns get zeros and a note."""
    return assess(recordings.select(key, "duration_ms").join(recording_metrics(turns, key, max_turn_ms), key, "left"), key, expected)


def assess(measured: DataFrame, key: str = "interview_id", expected: tuple[int, int] = (2, 2), keep: tuple[str, ...] = ()) -> DataFrame:
    """A4, A7, A8 of rows with the recording's duration and the columns of :func:`recording_metrics`; ``keep`` names columns to carry along."""
    there = F.col("turn_count").isNotNull()
    delta = F.when(F.col("last_ms") != 0, F.col("duration_ms") - F.col("last_ms"))
    counts = ["turn_count", "speaker_count", "long_turns", "empty_turns", "timestamp_regressions", "unknown_speakers", "missing_human_labels"]
    out = measured.withColumn("duration_delta_ms", delta)
    said = notes(F.col("speaker_count"), F.col("duration_delta_ms"), F.col("missing_human_labels"), F.col("timestamp_regressions"), F.col("unknown_speakers"), expected)
    return out.select(
        key,
        there.alias("canonical_exists"),
        F.col("duration_ms").alias("source_duration_ms"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in counts),
        F.when(F.col("total_ms") > 0, F.col("top_ms") / F.col("total_ms")).alias("speaker_time_ratio_max"),
        F.col("last_ms").alias("last_timestamp_ms"),
        "duration_delta_ms",
        F.when(F.col("duration_ms") > 0, F.col("last_ms") / F.col("duration_ms")).alias("coverage_ratio"),
        "max_gap_ms",
        F.when(there, said).otherwise(F.lit("missing_canonical")).alias("notes"),
        *keep,
    )


def ratio_text(ratio: Column, digits: int) -> Column:
    """A ratio with so many decimals: its double times a power of ten, to the nearest whole number, ties to even, as SQL's ``round_even`` has it; null for null."""
    scale = 10.0**digits
    return F.when(ratio.isNotNull(), F.format_string(f"%.{digits}f", F.rint(ratio * scale) / scale))


def text_view(rows: DataFrame, key: str = "interview_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The metrics as text, as in a CSV row: seconds with three decimals, ratios rounded, empty for null."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    times = {"source_duration_sec": "source_duration_ms", "last_timestamp_sec": "last_timestamp_ms", "duration_delta_sec": "duration_delta_ms", "max_gap_sec": "max_gap_ms"}
    return rows.select(
        key,
        F.lower(F.col("canonical_exists").cast("string")).alias("canonical_exists"),
        *(empty(seconds_text(F.col(ms))).alias(name) for name, ms in times.items()),
        *(F.col(c).cast("string").alias(c) for c in ("turn_count", "speaker_count", "long_turns", "empty_turns", "timestamp_regressions", "unknown_speakers", "missing_human_labels")),
        empty(ratio_text(F.col("speaker_time_ratio_max"), 3)).alias("speaker_time_ratio_max"),
        empty(ratio_text(F.col("coverage_ratio"), 4)).alias("coverage_ratio"),
        "notes",
        *keep,
    )


def report(rows: DataFrame, key: str = "interview_id", expected: tuple[int, int] = (2, 2)) -> DataFrame:
    """A row a recording as the text columns of the check's CSV, in their order.

    ``rows`` has the key, ``duration_ms`` and ``__duration`` (as text), the columns of :func:`recording_metrics` and
    :func:`raw_metrics`, null where there is nothing, and the presence of files, null for none.
    """
    empty = lambda c: F.coalesce(c, F.lit(""))
    mean = lambda c: empty(ratio_text(F.col(c), 3)).alias(c)
    counts = ("raw_segment_count", "raw_segments_without_speaker", "raw_word_count")
    means = ("raw_word_score_mean", "raw_avg_logprob_mean")
    plain, rendered = ("raw_json_exists", "wav_exists"), ("diarization_regular_exists", "diarization_exclusive_exists")
    keep = ("__duration", *plain, *rendered, *counts, *means)
    shown = text_view(assess(rows, key, expected, keep), key, keep)
    has = F.col("canonical_exists") == "true"
    values = {
        **{c: F.col(c) for c in shown.columns},
        **{c: F.coalesce(c, F.lit(False)).cast("string") for c in plain},
        **{c: (has & F.coalesce(c, F.lit(False))).cast("string") for c in rendered},
        "source_duration_sec": F.when(has, F.col("source_duration_sec")).otherwise(empty(F.col("__duration"))),
        "last_timestamp_sec": F.when(has, F.col("last_timestamp_sec")).otherwise(F.lit("0")),
        **{c: F.when(has, empty(F.col(c).cast("string"))).otherwise(F.lit("")) for c in counts},
        **{c: F.when(has, mean(c)).otherwise(F.lit("")) for c in means},
        "notes": F.when(has, F.col("notes")).otherwise(F.lit("missing canonical JSON")),
    }
    return shown.select(F.col(key).cast("string").alias("interview_id"), *(values[c].alias(c) for c in QC_COLUMNS[1:]))
