"""Few rows out of very many: around some anchors, or the first ones by any key.

Both look at little of the table first and prove that it is enough, so neither sorts or shuffles the table.
"""

from __future__ import annotations

import datetime as dt
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loglattice.functions.fields import Scope, quoted
from loglattice.operators.explore import PAGE_SIZE, _order, surrounding_many
from loglattice.operators.predicates import Predicate, filter_logs, time_range
from loglattice.plans.durable import written
from loglattice.view import ROLE_ALIASES, LogView

#: anchors that are sent to every executor; more are placed by :func:`surrounding_many`
FEW_ANCHORS = 10_000
#: rows of the sample that bounds are taken from
SAMPLE_ROWS = 20_000


# --- rows around few anchors --------------------------------------------------------------------

def _micros(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col)
    return F.unix_micros(col.cast("timestamp"))


def surrounding_few(
    df: DataFrame, view: LogView, anchors: DataFrame, n: int = 25, by: str | None = None, anchor_id: str = "anchor_id",
    reach_seconds: int = 60, growth: int = 16, most: int = FEW_ANCHORS,
) -> DataFrame:
    """What ``surrounding_many`` returns, for few anchors: only rows near them in time are read.

    Anchors and rows meet by (group, cell of time).  A cell is ``reach_seconds`` wide at first; the sides of anchors that
    found fewer than ``n`` rows go on with cells ``growth`` times as wide, until the cells hold all of the table's
    time.  The anchors, counted first, are broadcast; each scan is bounded by the time of those that are left, which also
    prunes partitions.  Rows without a time have no place around an anchor and do not take part; anchors without one find
    nothing.  Above ``most`` anchors ``surrounding_many`` does the work.
    """
    view.require("timestamp")
    by = by or view.service
    if not by or not view.row_id:
        raise ValueError("surrounding_few needs a grouping column and row_id columns")
    ids, scope = list(view.row_id), Scope(df, view)
    dtype = scope.role_type("timestamp")
    at = _micros(quoted(view.timestamp), dtype)
    few = anchors.filter(quoted(view.timestamp).isNotNull()).select(quoted(anchor_id).alias("a"), quoted(by).alias("__by"), at.alias("t"))
    few = written(few.select("a", "__by", "t", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")), "anchors")
    if few.count() > 2 * most:
        return surrounding_many(df.filter(quoted(view.timestamp).isNotNull()), view, anchors, n, by, anchor_id)
    lo, hi = df.agg(F.min(quoted(view.timestamp)).alias("lo"), F.max(quoted(view.timestamp)).alias("hi")).select(
        _micros(F.col("lo"), dtype), _micros(F.col("hi"), dtype)
    ).first()
    names = [view.timestamp, *[i for i in ids if i not in (by, view.timestamp)]]
    width, left, found = reach_seconds * 1_000_000, few, []
    while lo is not None:
        first, last = left.agg(F.min("t"), F.max("t")).first()
        if first is None:
            break
        cell = lambda c: F.floor(c / width)
        # a side of an anchor reaches into two cells
        ends = F.array_distinct(F.array(cell(F.col("t")), cell(F.col("t") + F.col("side") * width)))
        marks = left.select("a", F.col("__by").alias("m_by"), "t", "side", F.explode(ends).alias("m_cell"))
        near = filter_logs(df, view, time_range(_moment(first - width), _moment(last + width)))
        rows = near.select(quoted(by).alias("__by"), at.alias("__t"), *[quoted(c) for c in names])
        met = rows.join(F.broadcast(marks), F.col("__by").eqNullSafe(F.col("m_by")) & (cell(F.col("__t")) == F.col("m_cell")))
        ahead = (F.col("__t") - F.col("t")) * F.col("side")
        met = met.filter((ahead > 0) & (ahead <= width))
        # nearest first: the later row, and the larger id, on the side before
        order = [F.when(F.col("side") > 0, F.col("__t")).otherwise(-F.col("__t"))]
        for i in ids:
            order += [F.when(F.col("side") > 0, quoted(i)).asc_nulls_first(), F.when(F.col("side") < 0, quoted(i)).desc_nulls_last()]
        place = F.row_number().over(Window.partitionBy("a", "m_by", "t", "side").orderBy(*order))
        top = written(met.withColumn("place", place).filter(F.col("place") <= n), "anchors-near")
        found.append(top)
        enough = top.filter(F.col("place") == n).select("a", F.col("m_by").alias("e_by"), F.col("t").alias("e_t"), F.col("side").alias("e_side"))
        here = left.alias("l").join(
            F.broadcast(enough.withColumnRenamed("a", "e_a")),
            F.col("a").eqNullSafe(F.col("e_a")) & F.col("__by").eqNullSafe(F.col("e_by")) & (F.col("t") == F.col("e_t")) & (F.col("side") == F.col("e_side")), "left_anti",
        )
        more = F.when(F.col("side") < 0, F.col("t") - width > lo).otherwise(F.col("t") + width < hi)
        left = written(here.filter(more), "anchors-left")
        width *= growth
    kind = T.StructType([anchors.schema[anchor_id], T.StructField("offset", T.IntegerType()), df.schema[by], *[df.schema[c] for c in names]])
    if not found:
        return df.sparkSession.createDataFrame([], kind)
    # of a side that went on, only the last round counts: it found all that the earlier ones did
    rounds = [t.withColumn("round", F.lit(i)) for i, t in enumerate(found)]
    all_ = reduce(lambda x, y: x.unionByName(y), rounds)
    latest = F.max("round").over(Window.partitionBy("a", "m_by", "t", "side"))
    all_ = all_.withColumn("latest", latest).filter(F.col("round") == F.col("latest"))
    return all_.select(
        F.col("a").alias(anchor_id), (F.col("place") * F.col("side")).cast("int").alias("offset"), F.col("__by").alias(by), *[quoted(c) for c in names]
    )


def _moment(micros: int) -> dt.datetime:
    """The instant, as far as dates go."""
    return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=min(max(micros, -62135596800000000), 253402300799999999))


# --- the first rows by any key ------------------------------------------------------------------

def _beyond(keys: list[tuple[Column, bool]], bound: Row, strict: bool) -> Column:
    """Whether a row comes after (``strict``) the bound in the order of ``keys`` (column, descending), nulls last; or not before it."""
    out = F.lit(not strict)
    for (col, down), value in reversed(list(zip(keys, bound))):
        if value is None:  # nulls are last, so nothing but another null is not before it
            out = col.isNull() & out
            continue
        lit = F.lit(value)
        later = (col < lit if down else col > lit) | col.isNull()
        out = later | ((col == lit) & out)
    return F.coalesce(out, F.lit(False))


def first_rows(
    df: DataFrame, view: LogView, n: int = PAGE_SIZE, sort: str | None = None, descending: bool = True, offset: int = 0,
    where: Predicate | None = None, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Rows ``offset`` to ``offset + n`` in the order of ``explore`` and ``page``, by any column, without a sort of the table.

    Two rows of a sample bound the range that must hold them; counts prove that it does, or a wider range is taken.  Only
    that range is sorted: about the rows asked for and what the sample leaves open (a few times
    1 / sqrt(sample_rows) of the offset), however deep the page.  Ties of the sort column are told apart by the row id, so a
    column of few values does not widen the range; without row_id columns it does.
    """
    rows = filter_logs(df, view, where) if where is not None else df
    scope = Scope(rows, view)
    name = sort or view.timestamp
    if not name:
        raise ValueError("first_rows needs a sort column or a timestamp")
    role = {v: k for k, v in ROLE_ALIASES.items()}.get(name)
    keys = [(scope.role(role) if role else scope.get(name).column, descending)] + [(quoted(i), False) for i in view.row_id if i != name]
    order = _order(scope, sort, descending)
    total = rows.count()
    cut = rows.orderBy(*order).offset(offset).limit(n)
    if total <= sample_rows:
        return cut
    share = sample_rows / total
    some = rows.select(*[c.alias(f"k{i}") for i, (c, _) in enumerate(keys)]).sample(fraction=share, seed=17)
    listed = [F.col(f"k{i}").desc_nulls_last() if down else F.col(f"k{i}").asc_nulls_last() for i, (_, down) in enumerate(keys)]
    turned = [F.col(f"k{i}").asc_nulls_first() if down else F.col(f"k{i}").desc_nulls_first() for i, (_, down) in enumerate(keys)]

    def at(rank: int) -> Row | None:
        """The sample's row of a rank; None behind its end."""
        top = some.orderBy(*listed).limit(rank + 1)
        got = top.orderBy(*turned).limit(1).collect()
        return got[0] if got and top.count() == rank + 1 else None

    def spread(rank: float) -> float:
        return 4 * math.sqrt(max(rank, 1)) + 8

    slack, low, high, before = 1.0, None, None, 0
    aim = offset * share
    while aim - slack * spread(aim) > 0:
        low = at(int(aim - slack * spread(aim)))
        before = rows.filter(~_beyond(keys, low, strict=False)).count() if low is not None else 0
        if low is not None and before <= offset:
            break
        low, before, slack = None, 0, slack * 4
    slack, aim = 1.0, (offset + n) * share
    while True:
        high = at(int(aim + slack * spread(aim)))
        if high is None or rows.filter(~_beyond(keys, high, strict=True)).count() >= offset + n:
            break
        slack *= 4
    held = rows
    if low is not None:
        held = held.filter(_beyond(keys, low, strict=False))
    if high is not None:
        held = held.filter(~_beyond(keys, high, strict=True))
    return held.orderBy(*order).offset(offset - before).limit(n)
