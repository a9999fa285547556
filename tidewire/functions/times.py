"""Time functions as Columns: repair of clocks, windows and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(value: Column) -> Column:
    """A timestamp of seconds or milliseconds since 1970, given as a number or text; null if it is neither."""
    x = value.cast("string").try_cast("double")
    return F.when(x > 1e11, F.timestamp_millis(x.cast("long"))).otherwise(F.timestamp_seconds(x))


def event_bucket(ts: Column, days: int = 3) -> Column:
    """Number of the time bucket since 1970."""
    return F.floor(F.unix_timestamp(ts) / (days * 86400)).cast("long")


def local_time(text: Column, zone: str, formats: list[str]) -> Column:
    """A timestamp from text without a zone, by the first format that fits."""
    return F.to_utc_timestamp(F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats)), zone)


def repaired_clock(ts: Column, now: Column, zone_hours: int = 9) -> Column:
    """Future times: those about a zone's offset ahead are moved back by it, others are null."""
    ahead = (F.unix_timestamp(ts) - F.unix_timestamp(now)) / 3600
    back = F.timestamp_seconds(F.unix_timestamp(ts) - zone_hours * 3600)
    return F.when(ahead <= 0, ts).when(ahead.between(zone_hours - 1, zone_hours + 1), back)


def is_stale(ts: Column, now: Column, limit_hours: Column | int) -> Column:
    """Older than the limit; an undated item is fresh."""
    limit = F.lit(limit_hours) if isinstance(limit_hours, int) else limit_hours
    return F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(ts)) > limit * 3600, F.lit(False))


def age_limit_hours(hint: Column, slow_suffix: str, slow: int = 72, usual: int = 24) -> Column:
    return F.when(F.coalesce(hint, F.lit("")).endswith(slow_suffix), slow).otherwise(usual)


def in_window(ts: Column, since: Column, until: Column) -> Column:
    """since < ts <= until."""
    return (ts > since) & (ts <= until)


def dated_since(ts: Column, since: Column) -> Column:
    """Not before `since`; undated items are out."""
    return F.coalesce(ts >= since, F.lit(False))


def window_start(last_end: Column, now: Column, usual_hours: int = 24, most_days: int = 3) -> Column:
    """Where a window opens: at the end of the last one, at most so many days back; without a last one the usual hours back."""
    back = lambda seconds: F.timestamp_seconds(F.unix_timestamp(now) - seconds)
    return F.greatest(F.coalesce(last_end, back(usual_hours * 3600)), back(most_days * 86400))


def not_before_day(origin: Column, floor_day: Column) -> Column:
    """Not from a day before the floor, by the day of origin; an unknown origin is kept."""
    return F.coalesce(F.to_date(origin) >= floor_day, F.lit(True))


def not_before(origin: Column, since: Column) -> Column:
    """Not from before `since`, by the time of origin; an unknown origin is kept."""
    return F.coalesce(origin >= since, F.lit(True))


def edition_bounds(day: Column, zone: str = "Asia/Seoul", opens: str = "06:50:00", closes: str = "06:00:00") -> tuple[Column, Column]:
    """(since, until) of an edition: from the day before at `opens` to the day at `closes`, in a zone."""
    at = lambda d, t: F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", d.cast("string"), F.lit(t))), zone)
    return at(F.date_sub(day, 1), opens), at(day, closes)
