"""Column expressions on dates and times. Session time zone is taken to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MICROS = 1_000_000


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def to_epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def parse_timestamp(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Text to timestamp; text that does not fit becomes NULL."""
    return F.try_to_timestamp(text, F.lit(pattern))


def parse_date(text: Column) -> Column:
    """Leading ``yyyy-MM-dd`` of a text as a date, NULL if there is none."""
    return F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))


def whole_seconds(start: Column, end: Column) -> Column:
    """Seconds from start to end, rounded down (also below zero)."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(_MICROS)).cast("long")


def exact_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(_MICROS))


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def hour_bucket(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def hour_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH")


def calendar_date(ts: Column) -> Column:
    return F.to_date(ts)


def shift_micros(ts: Column, micros: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + micros)


def add_hours(ts: Column, hours: int) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(hours))
