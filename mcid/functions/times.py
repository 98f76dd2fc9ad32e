"""Clock arithmetic on epoch numbers (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_seconds(then: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (now - then).cast("double"))


def within_window(then: Column, now: Column, seconds: int) -> Column:
    return age_seconds(then, now) <= seconds


def day_text(ts_ms: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.date_format(F.timestamp_millis(ts_ms), pattern)


def session_id(ts_ms: Column) -> Column:
    """Name of the UTC calendar day that an identity belongs to."""
    return F.concat(F.lit("S-"), day_text(ts_ms))


def to_unix_ms(value: Column) -> Column:
    """Milliseconds from seconds or milliseconds: large numbers are already ms."""
    v = value.cast("double")
    return F.when(v > 1e12, v.cast("bigint")).otherwise((v * 1000).cast("bigint"))
