"""Turn user values into literals of a column's own type, before Spark sees them.

Under ANSI mode ``int_column = 'abc'`` fails at run time; here it fails while the plan is built,
and the literal has the column's type, so the comparison reaches the file scan.
"""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_number(value) -> int | float | None:
    """The number a value spells, or None."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, int):
        return value
    try:
        num = float(str(value).strip())
    except ValueError:
        return None
    if not math.isfinite(num):
        return None
    if num.is_integer():
        text = str(value).strip()
        return int(text) if text.lstrip("+-").isdigit() else int(num)
    return num


def as_datetime(value) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(str(value))


def naive_utc(value) -> dt.datetime:
    """An instant as a naive UTC datetime; naive values are taken as UTC."""
    d = as_datetime(value)
    return d.astimezone(dt.timezone.utc).replace(tzinfo=None) if d.tzinfo else d


def timestamp_literal(value, dtype: T.DataType) -> Column:
    """A literal comparable with a timestamp column of type ``dtype`` without casting the column."""
    d = naive_utc(value)
    if isinstance(dtype, T.DateType):
        return F.lit(d.date())
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(d.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(d.isoformat(sep=" ") + "+00:00").cast("timestamp")


def bound_literal(value, dtype: T.DataType, op: str) -> Column:
    """The bound of ``column op value`` (gt, gte, lt, lte) as a literal of the column's type.

    A date is the start of its day.  A time of day within a bound is rounded to the day that keeps the
    comparison true for the same dates: up for ``gte`` and ``lt``, down for ``gt`` and ``lte``.
    """
    if isinstance(dtype, T.DateType):
        d = naive_utc(value)
        inside = d.time() != dt.time(0)
        return F.lit(d.date() + dt.timedelta(days=int(inside and op in ("gte", "lt"))))
    return timestamp_literal(value, dtype)


def typed_literal(value, dtype: T.DataType) -> Column:
    """``value`` as a literal of type ``dtype``; ValueError when it does not fit."""
    try:
        if isinstance(dtype, T.BooleanType):
            if isinstance(value, bool):
                return F.lit(value)
            return F.lit({"true": True, "false": False, "1": True, "0": False}[str(value).strip().lower()])
        if isinstance(dtype, T.IntegralType):
            whole = as_number(value)
            return F.lit(whole if isinstance(whole, int) else int(str(value).strip())).cast(dtype)
        if isinstance(dtype, T.DecimalType):
            return F.lit(Decimal(str(value).strip())).cast(dtype)
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            return F.lit(float(value)).cast(dtype)
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return timestamp_literal(value, dtype)
    except (KeyError, ValueError, InvalidOperation) as e:
        raise ValueError(f"{value!r} is no value of type {dtype.simpleString()}") from e
    return F.lit(str(value))
