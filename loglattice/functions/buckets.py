"""Time buckets: fixed widths anchored at the epoch, calendar units, and automatic widths."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions.literals import naive_utc

# Bucket units and their length in seconds (month and year nominal).
UNIT_SECONDS = {
    "second": 1,
    "minute": 60,
    "hour": 3_600,
    "day": 86_400,
    "week": 604_800,
    "month": 2_592_000,
    "year": 31_536_000,
}
CALENDAR_UNITS = ("week", "month", "year")

# Widths the automatic interval chooses from, in seconds.
AUTO_STEPS = (
    10, 30, 60, 120, 300, 600, 1800, 3600, 7200, 21600, 86_400,
    2 * 86_400, 5 * 86_400, 10 * 86_400, 30 * 86_400, 90 * 86_400, 180 * 86_400, 365 * 86_400,
)
AUTO_BUCKETS = 60
EPOCH = dt.datetime(1970, 1, 1)


def span_seconds(from_, to) -> float:
    return (naive_utc(to) - naive_utc(from_)).total_seconds()


def auto_step(from_, to) -> int:
    """Bucket width in seconds giving about sixty buckets over the range."""
    raw = math.ceil(span_seconds(from_, to) / AUTO_BUCKETS)
    year = AUTO_STEPS[-1]
    return next((s for s in AUTO_STEPS if s >= raw), math.ceil(raw / year) * year)


def estimate_buckets(interval, from_, to) -> int:
    step = auto_step(from_, to) if interval == "auto" else step_seconds(interval)
    return math.ceil(span_seconds(from_, to) / step)


def step_seconds(interval) -> int:
    """Length of a bucket; ``interval`` is a unit name or a number of seconds."""
    if isinstance(interval, str):
        if interval not in UNIT_SECONDS:
            raise ValueError(f"unknown interval {interval!r}; use {', '.join(UNIT_SECONDS)}, 'auto' or seconds")
        return UNIT_SECONDS[interval]
    if interval <= 0 or int(interval) != interval:
        raise ValueError("a bucket width is a positive whole number of seconds")
    return int(interval)


def resolve_interval(interval, from_=None, to=None, max_buckets: int | None = None):
    """'auto' becomes a width; with ``max_buckets`` a unit with more buckets over the range is refused."""
    if interval == "auto":
        if from_ is None or to is None:
            raise ValueError("interval='auto' needs a time range")
        return auto_step(from_, to)
    step_seconds(interval)
    if max_buckets is not None and from_ is not None and to is not None:
        n = estimate_buckets(interval, from_, to)
        if n > max_buckets:
            raise ValueError(f"interval {interval!r} gives {n} buckets over this range, more than {max_buckets}")
    return interval


def bucket(ts: Column, interval, dtype: T.DataType) -> Column:
    """Start of the bucket a timestamp falls in, in UTC; keeps the timestamp's type."""
    if interval in CALENDAR_UNITS:
        if not isinstance(dtype, T.TimestampType):
            return F.date_trunc(interval, ts).cast(dtype)
        # an instant as UTC wall clock and back, whatever the session's time zone
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        wall = F.timestamp_add("MICROSECOND", F.unix_micros(ts), epoch)
        start = F.date_trunc(interval, wall).cast("timestamp_ntz")
        return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, start))
    if isinstance(dtype, T.DateType):
        ts = ts.cast("timestamp_ntz")
    return F.window(ts, f"{step_seconds(interval)} seconds")["start"].cast(dtype)


def floor_to(value, interval) -> dt.datetime:
    """Driver-side bucket start of one instant, for fixed widths."""
    d = naive_utc(value)
    step = dt.timedelta(seconds=step_seconds(interval))
    return EPOCH + ((d - EPOCH) // step) * step
