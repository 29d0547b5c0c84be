"""Date and time expressions. Timestamps are UTC; epoch milliseconds are the stored form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since the epoch, rounded down."""
    return F.unix_millis(ts.cast("timestamp"))


def day_from_millis(ms: Column) -> Column:
    return F.to_date(F.timestamp_millis(ms))


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts.cast("timestamp"))


def hour_from_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(3600)))


def hour_label(ts: Column) -> Column:
    """For example ``03 Jan 2024 05:00``."""
    return F.date_format(ts, "dd MMM yyyy HH:mm")


def day_number(value: Column) -> Column:
    """``20240103`` as an integer."""
    return F.date_format(value, "yyyyMMdd").cast("int")


def month_number(value: Column) -> Column:
    return F.date_format(value, "yyyyMM").cast("int")


def from_us_date_and_time(date_text: Column, time_text: Column) -> Column:
    """``1/31/2024`` and ``5:07`` to a timestamp; NULL when they do not parse."""
    joined = F.concat_ws(" ", date_text, time_text)
    return F.try_to_timestamp(joined, F.lit("M/d/yyyy H:mm"))


def interval_start(ts: Column, seconds: int) -> Column:
    """Start of the fixed-length interval, counted from the epoch, that holds ``ts``."""
    epoch = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(epoch - F.pmod(epoch, F.lit(seconds)))


def slots_covered(start: Column, duration_seconds: Column, slot_seconds: int) -> Column:
    """Array with the start of every slot touched by ``[start, start + duration]``."""
    first = F.unix_seconds(start.cast("timestamp"))
    last = first + duration_seconds
    step = F.lit(slot_seconds)
    starts = F.sequence(first - F.pmod(first, step), last - F.pmod(last, step), step.cast("long"))
    return F.transform(starts, lambda s: F.timestamp_seconds(s))


def plus_days(value: Column, days: int | Column) -> Column:
    return F.date_add(value, days)


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
