"""Times as text (P9-P11, P19, P28).  Times are whole milliseconds; text is made from integers only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_ms(seconds: Column) -> Column:
    """Seconds to milliseconds, ties to even."""
    return F.rint(seconds * 1000).cast("bigint")


def clock(ms: Column) -> Column:
    """HH:MM:SS of milliseconds, hours unbounded, nothing below zero; seconds are rounded, ties to even."""
    total = F.rint(F.greatest(ms, F.lit(0)) / 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60)


def timecode(ms: Column, mark: str = ".") -> Column:
    """HH:MM:SS.mmm."""
    ms = F.greatest(ms, F.lit(0)).cast("bigint")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3600000), F.floor(ms % 3600000 / 60000), F.floor(ms % 60000 / 1000), ms % 1000)


def truncated_clock(seconds: Column) -> Column:
    """P10: HH:MM:SS, fractions cut off; null is zero."""
    total = F.greatest(F.coalesce(seconds, F.lit(0.0)).cast("bigint"), F.lit(0))
    return F.format_string("%02d:%02d:%02d", F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60)


def cue_end(start_ms: Column, end_ms: Column) -> Column:
    """The end of a cue; one that isn't after the start is a quarter second later."""
    end_ms = F.coalesce(F.nullif(end_ms, F.lit(0)), start_ms)
    return F.when(end_ms <= start_ms, start_ms + 250).otherwise(end_ms)


def seconds_text(ms: Column) -> Column:
    """Seconds with three decimals, from milliseconds."""
    ms = ms.cast("bigint")
    return F.when(ms.isNotNull(), F.concat(F.when(ms < 0, F.lit("-")).otherwise(F.lit("")), F.format_string("%d.%03d", F.floor(F.abs(ms) / 1000), F.abs(ms) % 1000)))


def parse_timecode(text: Column) -> Column:
    """Seconds of h:m:s, m:s or s, comma or dot decimals; null if it is none of them."""
    parts = F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":")

    def whole(i: int) -> Column:
        return F.get(parts, F.lit(i)).try_cast("int")

    def real(i: int) -> Column:
        return F.get(parts, F.lit(i)).try_cast("double")

    return F.when(F.size(parts) == 3, whole(0) * 3600 + whole(1) * 60 + real(2)).when(F.size(parts) == 2, whole(0) * 60 + real(1)).when(F.size(parts) == 1, real(0))


def eta_text(seconds: Column) -> Column:
    """A remaining time in words."""
    total = F.rint(seconds).cast("bigint")
    minutes = F.floor(total / 60)
    return (
        F.when(seconds.isNull() | (seconds <= 0), F.lit("estimando..."))
        .when(total < 60, F.format_string("cerca de %ds", total))
        .when(minutes < 60, F.format_string("cerca de %dmin %02ds", minutes, total % 60))
        .otherwise(F.format_string("cerca de %dh %02dmin", F.floor(minutes / 60), minutes % 60))
    )


def eta(elapsed: Column, percent: Column) -> Column:
    """The remaining time from what has passed and the percentage done."""
    return F.when(percent >= 100, F.lit("concluindo...")).when((percent < 8) | (elapsed < 15), F.lit("estimando...")).otherwise(eta_text(elapsed * (100 - percent) / F.greatest(percent, F.lit(1))))
