"""Progress of jobs (P37, W14, W15, ST5 in batch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shares of the steps prepare, transcribe, diarize, render, check in a run's time, by device and model.
WEIGHTS = {
    "cuda": {"tiny": (5, 38, 56, 1, 0), "base": (5, 38, 56, 1, 0), "small": (4, 45, 50, 1, 0), "medium": (4, 50, 45, 1, 0), "large-v3-turbo": (4, 48, 47, 1, 0), "large-v3": (3, 63, 33, 1, 0)},
    "cpu": {"tiny": (2, 50, 47, 1, 0), "base": (2, 50, 47, 1, 0), "small": (1, 55, 43, 1, 0), "medium": (1, 55, 43, 1, 0), "large-v3-turbo": (2, 59, 39, 0, 0), "large-v3": (1, 65, 33, 1, 0)},
}
FALLBACK = WEIGHTS["cuda"]["large-v3-turbo"]


def weights(model: str, device: str) -> tuple[int, ...]:
    """The shares for a model on a device."""
    return WEIGHTS["cuda" if device == "cuda" else "cpu"].get(model, FALLBACK)


def ranges(steps: DataFrame, keys: list[str], order: str, weight: str = "weight") -> DataFrame:
    """Where each step starts and ends in percent, by running sums of weights; all zero where the sum is."""
    every = Window.partitionBy(*keys)
    running = every.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total, upto = F.sum(weight).over(every), F.sum(weight).over(running)
    percent = lambda x: F.coalesce(F.floor(F.try_divide(x * 100, total)), F.lit(0)).cast("int")
    return steps.withColumn("start_percent", percent(upto - F.col(weight))).withColumn("end_percent", percent(upto))


def overall(start: Column, end: Column, inner: Column) -> Column:
    """The overall percentage at a step's inner percentage, which is clamped; null counts as 0."""
    clamped = F.least(F.greatest(F.coalesce(inner, F.lit(0)), F.lit(0)), F.lit(100))
    return (start + F.floor((end - start) * clamped / 100)).cast("int")


def monotone(events: DataFrame, keys: list[str], order: str, progress: str = "progress", cap: int = 100) -> DataFrame:
    """Progress that never falls: the running maximum, capped."""
    running = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("shown", F.least(F.coalesce(F.max(progress).over(running), F.lit(0)), F.lit(cap)))


def download_percent(size: Column, baseline: Column, estimated: Column, start: int = 0, end: int = 100) -> Column:
    """ST5: the overall percentage of a download from the size of its folder; 0 of the inner range if no size is expected."""
    inner = F.when(estimated > 0, F.least(F.lit(100), F.floor((size - baseline) * 100 / estimated))).otherwise(F.lit(0))
    return (F.lit(start) + F.floor((end - start) * inner / 100)).cast("int")
