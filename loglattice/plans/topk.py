"""The first rows by time, of tables with very many scan tasks.

``orderBy(ts).limit(n)`` reads every wanted column of every row and sends ``n`` rows of every task
to a single one.  On a large table it pays to look at the timestamps first: count rows per minute,
find the minute that the n-th row falls in, and let that bound prune the scan of the wide rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loglattice.functions.buckets import bucket
from loglattice.functions.coarse import coarse_column
from loglattice.functions.fields import Scope
from loglattice.view import LogView

_FAR = {True: "0001-01-01 00:00:00", False: "9999-12-31 23:59:59"}


def within(scope: Scope, lo: Column | None, hi: Column | None, keep_null: bool = False) -> Column:
    """Timestamp role between two columns (scalar subqueries), asked of the partition column too.

    The two tests stay apart, so that one reaches the file statistics and the other the partitions.
    """
    view = scope.view
    sides = [(scope.role("timestamp"), lo, hi)]
    if view.partition_col:
        p = scope.get(view.partition_col)
        ts_type = scope.role_type("timestamp")
        down = lambda c: None if c is None else coarse_column(c, ts_type, view.partition_by, p.dtype)
        sides.append((p.column, down(lo), down(hi)))
    out = None
    for col, low, high in sides:
        tests = ([col >= low] if low is not None else []) + ([col <= high] if high is not None else [])
        test = reduce(lambda a, b: a & b, tests)
        test = test | col.isNull() if keep_null else test
        out = test if out is None else out & test
    return out


def bounded_by_time(rows: DataFrame, view: LogView, n: int, newest: bool = True, force: bool = False) -> DataFrame:
    """The rows that can be among the first ``n`` by time; a superset, still to be sorted and cut.

    Without ``force`` the rows as they are.  The minute that holds the n-th row is found in two levels:
    among the days, then among the minutes of one day, so what one task orders is a row per day or 1,440.
    """
    if not force:
        return rows
    scope = Scope(rows, view)
    dtype = scope.role_type("timestamp")
    minute = bucket(scope.role("timestamp"), "minute", dtype).alias("__m")
    minutes = rows.filter(scope.role("timestamp").isNotNull()).groupBy(minute).agg(F.count("*").alias("__n"))
    minutes = minutes.withColumn("__d", F.to_date("__m"))
    days = minutes.groupBy("__d").agg(F.sum("__n").alias("__n"))
    turned = lambda c: F.col(c).desc() if newest else F.col(c).asc()
    running = days.withColumn("__seen", F.sum("__n").over(Window.orderBy(turned("__d"))))
    last = running.filter(F.col("__seen") >= n).orderBy("__seen", turned("__d")).limit(1)
    edge_day = last.select("__d", (F.col("__seen") - F.col("__n")).alias("__before"))
    inside = minutes.join(F.broadcast(edge_day), "__d")  # one row
    seen = inside.withColumn("__sum", F.col("__before") + F.sum("__n").over(Window.partitionBy("__d").orderBy(turned("__m"))))
    enough = F.when(F.col("__sum") >= n, F.col("__m"))
    edge = F.max(enough) if newest else F.min(enough) + F.expr("interval 1 minute")
    far = F.lit(_FAR[newest]).cast(dtype)
    bound = seen.agg(F.coalesce(edge.cast(dtype), far).alias("__edge")).scalar()
    # rows without a timestamp sort last and may still be needed to fill up
    return rows.filter(within(scope, bound, None, True) if newest else within(scope, None, bound, True))
