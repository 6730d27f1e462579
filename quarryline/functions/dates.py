"""Times as epoch milliseconds and as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms(at: Column) -> Column:
    """A time without zone counts as one of the session's zone."""
    return F.unix_millis(at.cast("timestamp"))


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def parsed(text: Column) -> Column:
    """A time in ISO form, with or without zone; null for other text."""
    return F.try_to_timestamp(text)


def shown(at: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    return F.date_format(at, pattern)


def age_hours(at: Column, now: Column) -> Column:
    return (epoch_ms(now) - epoch_ms(at)) / 3_600_000
