"""Order-dependent work (lag, running sums) on groups too large for one task.

A window partitioned by the group puts the whole group in one task.  Here the rows are range
partitioned by (group, order), which balances them whatever the groups look like; each partition is
a *block* of consecutive rows of a group.  Windows run inside blocks, and what crosses a block edge
travels through one summary row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loglattice.plans.durable import durable

BLOCK = "__block"


def into_blocks(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Number the blocks; blocks of a group ascend in its order.

    The numbering comes from one range shuffle, so it is written out before it is used twice.
    """
    ranged = df.repartitionByRange(*by, *order)
    return durable(ranged.withColumn(BLOCK, F.spark_partition_id()))


def _in_block(by: list[str], order: list[str]):
    return Window.partitionBy(*by, BLOCK).orderBy(*order)


def _over_blocks(by: list[str]):
    # one row per block of the group, so at most as many rows as there are shuffle partitions
    return Window.partitionBy(*by).orderBy(BLOCK)


def _attach(df: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    """Null-safe join of the per-block summary, so a NULL group keeps its rows."""
    keys = [*by, BLOCK]
    right = summary.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in summary.columns if c not in keys])
    cond = None
    for k in keys:
        eq = df[k].eqNullSafe(right[f"__r_{k}"])
        cond = eq if cond is None else cond & eq
    return df.join(right, cond, "left").drop(*[f"__r_{k}" for k in keys])


def running_sum(df: DataFrame, value: Column, by: list[str], order: list[str], out: str) -> DataFrame:
    """Inclusive running sum of ``value`` along each group of a blocked frame."""
    df = df.withColumn("__v", value)
    before = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*by, BLOCK)
        .agg(F.sum("__v").alias("__sum"))
        .select(*by, BLOCK, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    )
    inner = _in_block(by, order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("__local", F.sum("__v").over(inner))
    return _attach(local, offsets, by).withColumn(out, F.col("__offset") + F.col("__local")).drop(
        "__v", "__offset", "__local"
    )


def previous(df: DataFrame, value: Column, by: list[str], order: list[str], out: str) -> DataFrame:
    """``value`` of the preceding row of the group in a blocked frame; NULL on its first row."""
    df = df.withColumn("__v", F.struct(value.alias("v")))
    last = (
        df.groupBy(*by, BLOCK)
        .agg(F.max_by("__v", F.struct(*order)).alias("__last"))
        .select(*by, BLOCK, F.lag("__last").over(_over_blocks(by)).alias("__edge"))
    )
    local = df.withColumn("__lag", F.lag("__v").over(_in_block(by, order)))
    return (
        _attach(local, last, by)
        .withColumn(out, F.coalesce(F.col("__lag"), F.col("__edge"))["v"])
        .drop("__v", "__lag", "__edge")
    )
