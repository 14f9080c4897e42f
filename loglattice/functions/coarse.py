"""Partition columns: the timestamp truncated in UTC.

A day is a DATE, finer units are whole units since 1970 (BIGINT), so neither writing nor reading
depends on the session's time zone.  Existing tables may also hold the truncation as a timestamp.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions.buckets import EPOCH, UNIT_SECONDS
from loglattice.functions.literals import naive_utc, timestamp_literal


def coarse_literal(value, unit: str, dtype: T.DataType) -> Column:
    """The truncation of one instant, as a literal of the partition column's type."""
    step = dt.timedelta(seconds=UNIT_SECONDS[unit])
    n = (naive_utc(value) - EPOCH) // step
    return F.lit(n) if isinstance(dtype, T.IntegralType) else timestamp_literal(EPOCH + n * step, dtype)


def coarse_column(ts: Column, ts_type: T.DataType, unit: str, dtype: T.DataType) -> Column:
    """The truncation of a timestamp column, as a column of the partition column's type."""
    step = UNIT_SECONDS[unit]
    if isinstance(ts_type, T.TimestampType):
        n = F.floor(F.unix_seconds(ts) / step)
        days = F.floor(F.unix_seconds(ts) / 86_400)
        at = F.timestamp_seconds(n * step)
    else:
        days = F.date_diff(ts, F.lit("1970-01-01").cast("date"))
        day_seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts)) if unit != "day" else F.lit(0)
        n = F.floor((days.cast("bigint") * 86_400 + day_seconds) / step)
        at = F.date_trunc(unit, ts)
    if isinstance(dtype, T.IntegralType):
        return n.cast(dtype)
    if isinstance(dtype, T.DateType):
        return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))
    return at.cast(dtype)
