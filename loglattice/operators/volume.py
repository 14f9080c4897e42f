"""Row counts per time bucket, alone or broken down by severity or by the top values of a field."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loglattice.functions.buckets import CALENDAR_UNITS, bucket, floor_to, resolve_interval, step_seconds
from loglattice.functions.fields import Scope
from loglattice.functions.literals import naive_utc, timestamp_literal
from loglattice.operators.predicates import Predicate, filter_logs, time_range
from loglattice.plans.joins import BROADCAST_ROWS, broadcast_if_bounded
from loglattice.view import LogView

OTHER = "Other"
UNKNOWN = "unknown"

# Order in which severities are stacked and listed.
SEVERITY_ORDER = (
    "critical", "fatal", "error", "err", "warn", "warning",
    "info", "information", "debug", "trace", "unknown",
)


def volume(
    df: DataFrame,
    view: LogView,
    interval: str | int = "auto",
    by: str | None = None,
    top: int = 10,
    where: Predicate | None = None,
    time: tuple | None = None,
    max_buckets: int | None = None,
) -> DataFrame:
    """(time, level, count).  Rows without a timestamp are in no bucket.

    ``max_buckets`` refuses an interval with more buckets over ``time``.
    ``by=None``: one series with level ''.  ``by="severity"``: the severity role, case kept, NULL
    as 'unknown'.  ``by=<field>``: its ``top`` most frequent values over the whole filtered range,
    everything else (and NULL) as 'Other'.
    """
    view.require("timestamp")
    from_, to = time if time else (None, None)
    interval = resolve_interval(interval, from_, to, max_buckets)
    rows = filter_logs(df, view, time_range(from_, to)) if time else df
    if where is not None:
        rows = filter_logs(rows, view, where)
    scope = Scope(rows, view)
    rows = rows.filter(scope.role("timestamp").isNotNull())
    at = bucket(scope.role("timestamp"), interval, scope.role_type("timestamp")).alias("time")
    if by is None:
        return rows.groupBy(at).agg(F.count("*").alias("count")).select("time", F.lit("").alias("level"), "count")
    if by == "severity" and (view.severity or scope.resolve("severity") is None):
        view.require("severity")
        level = F.coalesce(scope.get(view.severity).field.as_string(), F.lit(UNKNOWN))
        return rows.groupBy(at, level.alias("level")).agg(F.count("*").alias("count"))
    value = scope.get(by).field.as_string()
    return top_levels(rows.groupBy(at, value.alias("__v")).agg(F.count("*").alias("__n")), top)


def top_levels(counts: DataFrame, top: int) -> DataFrame:
    """Keep the ``top`` values of (time, __v, __n) counts and fold the rest into 'Other'.

    The ranking and the folding both read the same counts (one scan, one shuffled aggregate).  NULL
    takes part in the ranking and is then folded.
    """
    ranked = (
        counts.groupBy(F.col("__v").alias("__top"))
        .agg(F.sum("__n").alias("__total"))
        .orderBy(F.desc("__total"), F.asc_nulls_last("__top"))
        .limit(top)
        .select("__top")
    )
    level = F.coalesce(F.col("__top"), F.lit(OTHER)).alias("level")
    return (
        counts.join(broadcast_if_bounded(ranked, top), F.col("__v") == F.col("__top"), "left")
        .groupBy("time", level)
        .agg(F.sum("__n").alias("count"))
    )


def zero_fill(vol: DataFrame, interval: str | int, from_, to, levels: Sequence[str] | None = None) -> DataFrame:
    """Add zero rows for missing buckets from floor(from) while below ``to``, for every level.

    Calendar buckets are returned as they are.  The grid is buckets x levels; buckets are bounded by
    the range, levels are the distinct ones of the volume unless given.
    """
    interval = resolve_interval(interval, from_, to)
    if interval in CALENDAR_UNITS:
        return vol
    step = step_seconds(interval)
    start, end = floor_to(from_, interval), naive_utc(to) - dt.timedelta(microseconds=1)
    dtype = vol.schema["time"].dataType
    if levels is None:
        named = vol.groupBy("level").agg(F.lit(1).alias("__one")).select("level")
    else:
        named = vol.sparkSession.createDataFrame([(x,) for x in levels], "level string")
    slots = F.sequence(
        timestamp_literal(start, dtype), timestamp_literal(end, dtype), F.make_dt_interval(secs=F.lit(step))
    )
    grid = named.select("level", F.explode(slots).alias("time"))
    zero = grid.select("time", "level", F.lit(0).cast("bigint").alias("count"))
    inside = (F.col("time") >= timestamp_literal(start, dtype)) & (F.col("time") <= timestamp_literal(end, dtype))
    return zero.unionByName(vol.filter(inside)).groupBy("time", "level").agg(F.sum("count").alias("count"))


def pivot_volume(vol: DataFrame, levels: Sequence[str]) -> DataFrame:
    """One row per bucket, one column per level, zero where a level is absent."""
    aggs = [F.coalesce(F.sum(F.when(F.col("level") == x, F.col("count"))), F.lit(0)).alias(x or "count") for x in levels]
    return vol.groupBy("time").agg(*aggs)


def volume_totals(vol: DataFrame) -> DataFrame:
    """Totals per bucket ('bucket'), per level ('level') and overall ('all'), and the fullest bucket ('max')."""
    sets = vol.groupingSets([["time"], ["level"], []], "time", "level").agg(
        F.sum("count").alias("total"), F.grouping("time").alias("gt"), F.grouping("level").alias("gl")
    )
    kind = F.when(F.col("gt") == 0, "bucket").when(F.col("gl") == 0, "level").otherwise("all")
    totals = sets.select(kind.alias("kind"), "time", "level", "total")
    peak = totals.filter(F.col("kind") == "bucket").agg(F.max("total").alias("total"))
    ts = vol.schema["time"].dataType
    return totals.unionByName(
        peak.select(F.lit("max").alias("kind"), F.lit(None).cast(ts).alias("time"), F.lit(None).cast("string").alias("level"), "total")
    )


def volume_vs_previous(
    df: DataFrame, view: LogView, from_, to, interval: str | int, where: Predicate | None = None
) -> DataFrame:
    """Buckets of [from, to) beside the equally long window before it, from one pass.

    Earlier rows are shifted forward by the span and counted in the bucket they then fall in.
    """
    view.require("timestamp")
    lo, hi = naive_utc(from_), naive_utc(to)
    span = hi - lo
    interval = resolve_interval(interval, lo, hi)
    if interval in CALENDAR_UNITS:
        raise ValueError("windows of equal span are compared over fixed-width buckets")
    rows = filter_logs(df, view, time_range(lo - span, hi, closed=False))
    if where is not None:
        rows = filter_logs(rows, view, where)
    scope = Scope(rows, view)
    ts, dtype = scope.role("timestamp"), scope.role_type("timestamp")
    current = ts >= timestamp_literal(lo, dtype)
    shifted = F.when(current, ts).otherwise(ts + F.lit(span)).cast(dtype)
    staged = rows.select(shifted.alias("__ts"), current.alias("__now"))
    at = bucket(F.col("__ts"), interval, dtype).alias("time")
    return staged.groupBy(at).agg(
        F.count_if("__now").alias("count"), F.count_if(~F.col("__now")).alias("previous")
    )


def severity_rank(level: Column) -> Column:
    """1 for the gravest severity, ignoring case; unlisted names come after all listed ones."""
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.lower(level)).cast("int")
    return F.when(place > 0, place).otherwise(F.lit(len(SEVERITY_ORDER) + 1))


def rank_levels(vol: DataFrame) -> DataFrame:
    """(level, total, rank): largest total first, 'Other' last whatever its total.

    Levels are few (a breakdown has ``top`` + 1), so one task ranks them.
    """
    totals = vol.groupBy("level").agg(F.sum("count").alias("total"))
    w = Window.orderBy((F.col("level") == OTHER).asc(), F.desc("total"), F.asc("level"))
    return totals.select("level", "total", F.row_number().over(w).alias("rank"))
