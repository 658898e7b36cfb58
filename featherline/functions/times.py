"""Time arithmetic that works alike on TIMESTAMP and TIMESTAMP_NTZ (session zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def minutes(n: Column) -> Column:
    """An interval of `n` whole minutes, NULL for a missing `n`."""
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def minutes_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(6e7)


def hours_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(3.6e9)


def at_hour(day: Column, hour: int, like: str) -> Column:
    """`hour` o'clock on a date, as the timestamp type named by `like`."""
    return (day.cast(like) + F.make_dt_interval(F.lit(0), F.lit(hour))).cast(like)


def month_day(ts: Column) -> Column:
    """Month and day as one number, 615 for 15 June."""
    return F.month(ts) * 100 + F.dayofmonth(ts)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / F.lit(60.0)


def offset_minutes(ts: Column, offset: float | Column) -> Column:
    """Minutes since the start of a day that begins `offset` minutes before midnight."""
    offset = F.lit(offset) if isinstance(offset, (int, float)) else offset
    return F.pmod(minute_of_day(ts) + offset, F.lit(1440.0))
