"""Column expressions: cleaning, time, and error terms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPOCH = "1970-01-01 00:00:00"


def number(c: str | Column) -> Column:
    """Text or numeric column as double; unreadable text ('NaT', '') and NaN become NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c.try_cast("double"), F.lit(float("nan")))


def at_hour(day: str | Column, hour: str | Column, pattern: str = "yyyyMMdd") -> Column:
    """Timestamp (no zone) of a date given as text or number and an hour of that date."""
    day = F.col(day) if isinstance(day, str) else day
    hour = F.col(hour) if isinstance(hour, str) else hour
    start = F.to_timestamp_ntz(day.cast("string"), F.lit(pattern))
    return start + F.make_dt_interval(hours=hour.cast("int"))


def shift_hours(ts: str | Column, hours: int) -> Column:
    """Fixed-offset shift, e.g. -8 from UTC+8 wall time to UTC."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts + F.make_dt_interval(hours=F.lit(hours))


def hour_of(ts: str | Column) -> Column:
    """Timestamp truncated to its hour, staying zone-free."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def as_instant(ts: str | Column) -> Column:
    """Zone-free time read as UTC, as a TIMESTAMP, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), ts))


def as_wall_time(ts: str | Column) -> Column:
    """The inverse of ``as_instant``."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit(EPOCH).cast("timestamp_ntz"))


def clip_missing(c: str | Column, lowest: float = 0.0) -> Column:
    """At least ``lowest``; a missing forecast becomes ``lowest``."""
    return F.greatest(F.lit(lowest), number(c))


def ape_ratio(actual: Column, predicted: Column) -> Column:
    """|a-p| / (a+p), 0 where a+p is 0, NULL where either side is missing."""
    total = actual + predicted
    return F.when(total == 0, F.lit(0.0)).otherwise(F.abs(actual - predicted) / F.nullif(total, F.lit(0.0)))


def abs_ratio(actual: Column, predicted: Column) -> Column:
    """|p-a| / (|p|+|a|) with no rule for 0/0: that term is missing."""
    return F.try_divide(F.abs(predicted - actual), F.abs(predicted) + F.abs(actual))
