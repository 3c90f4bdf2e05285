"""Interval joins within a recording (J1, J2, J14) and merging of spans.

Both sides are filed under time bins (``bin_ms``), so one long recording is dealt over many tasks: an equi join on
(recording, bin) with the overlap as a residual condition, each pair kept only in the bin where both have begun.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_MS = 600_000


def _bins(start: Column, end: Column, size: int) -> Column:
    first, last = F.floor(start / size), F.floor(F.greatest(end - 1, start) / size)
    return F.sequence(first, last)


def overlaps(items: DataFrame, spans: DataFrame, key: str = "interview_id", bin_ms: int = BIN_MS, outer: bool = False) -> DataFrame:
    """Pairs of items and spans of one recording that overlap by more than nothing.

    Columns: all of the items, ``span_idx``, ``span_speaker``, ``overlap_ms``.  With ``outer`` each item also has rows
    with nulls there, one for each of its bins that no span meets.
    """
    left = items.withColumn("__bin", F.explode(_bins(F.col("start_ms"), F.col("end_ms"), bin_ms))).withColumn("__first", F.floor(F.col("start_ms") / bin_ms))
    right = spans.where("end_ms > start_ms").select(F.col(key).alias("__key"), F.col("idx").alias("span_idx"), F.col("speaker").alias("span_speaker"), F.col("start_ms").alias("__from"), F.col("end_ms").alias("__to"))
    right = right.withColumn("__span_bin", F.explode(_bins(F.col("__from"), F.col("__to"), bin_ms)))
    met = left.join(right, (F.col(key) == F.col("__key")) & (F.col("__bin") == F.col("__span_bin")) & (F.col("start_ms") < F.col("__to")) & (F.col("__from") < F.col("end_ms")), "left" if outer else "inner")
    met = met.where(F.col("__from").isNull() | (F.col("__bin") == F.greatest("__first", F.floor(F.col("__from") / bin_ms))))
    overlap = F.when(F.col("__from").isNotNull(), F.least("end_ms", "__to") - F.greatest("start_ms", "__from"))
    return met.withColumn("overlap_ms", overlap).where("overlap_ms > 0" + " OR overlap_ms IS NULL" * outer).drop("__key", "__bin", "__first", "__span_bin", "__from", "__to")


def best_overlap(items: DataFrame, spans: DataFrame, item_cols: list[str], key: str = "interview_id", bin_ms: int = BIN_MS, outer: bool = False) -> DataFrame:
    """For each item (named by key and ``item_cols``) that overlaps a span (with ``outer``, for each item): ``best_speaker``, that of the
    single longest overlap, ties to the first span, null if it has none; ``n_speakers``, distinct non-empty ones."""
    best = F.max(F.when(F.col("overlap_ms").isNotNull(), F.struct("overlap_ms", (-F.col("span_idx")).alias("order"), "span_speaker")))
    met = overlaps(items.select(*dict.fromkeys((key, *item_cols, "start_ms", "end_ms"))), spans, key, bin_ms, outer)
    found = met.groupBy(key, *item_cols).agg(best.alias("b"), F.count_distinct(F.nullif(F.trim("span_speaker"), F.lit(""))).alias("n_speakers"))
    return found.select(key, *item_cols, F.nullif("b.span_speaker", F.lit("")).alias("best_speaker"), F.col("b.overlap_ms").alias("overlap_ms"), "n_speakers")


def stab(points: DataFrame, turns: DataFrame, key: str = "interview_id", at: str = "at_ms", bin_ms: int = BIN_MS) -> DataFrame:
    """For each point in time the first turn with start <= t < end; null without one.  Points need a unique (key, ``at``)."""
    right = turns.where("end_ms > start_ms").select(F.col(key).alias("__key"), F.col("turn").alias("__turn"), "start_ms", "end_ms")
    right = right.withColumn("__bin", F.explode(_bins(F.col("start_ms"), F.col("end_ms"), bin_ms)))
    met = points.join(right, (F.col(key) == F.col("__key")) & (F.floor(F.col(at) / bin_ms) == F.col("__bin")) & (F.col("start_ms") <= F.col(at)) & (F.col(at) < F.col("end_ms")), "left")
    return met.groupBy(*points.columns).agg(F.min("__turn").alias("turn"))


def merge_spans(spans: DataFrame, keys: list[str], collar_ms: int = 500, min_ms: int = 0) -> DataFrame:
    """Drop spans shorter than ``min_ms``, then merge spans of the same keys whose gap is less than the collar.

    Result: keys, start_ms, end_ms, spans (how many were merged).
    """
    kept = spans.where(F.col("end_ms") - F.col("start_ms") >= min_ms)
    order = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = kept.withColumn("__new", F.when(F.col("start_ms") - reach < collar_ms, 0).otherwise(1))
    grouped = marked.withColumn("__group", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "__group").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("spans")).drop("__group")
