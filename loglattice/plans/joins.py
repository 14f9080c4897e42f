"""Joins that stay balanced whatever the keys look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rows a side may be proven to have and still be sent to every executor
BROADCAST_ROWS = 10_000
#: rows of one key above which the key is spread over several tasks
HOT_ROWS = 5_000_000
#: ``hot_rows`` from which the list of hot keys is short enough for every executor
SURELY_FEW = 1_000_000


def broadcast_if_bounded(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Mark a side for broadcast only when a LIMIT (or the schema) bounds it; else leave it to AQE."""
    return F.broadcast(df) if max_rows is not None and max_rows <= BROADCAST_ROWS else df


def join_group_facts(
    rows: DataFrame,
    facts: DataFrame,
    on: str,
    row_hash: Column,
    size_col: str = "n_rows",
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Attach one-row-per-key ``facts`` to ``rows``, spreading hot keys.

    ``facts[size_col]`` counts the rows of each key.  Rows of keys above ``hot_rows`` get a salt from
    ``row_hash`` and their single fact row is repeated once per salt.  All other keys join with salt 0.
    There are at most total rows / hot_rows hot keys: from ``SURELY_FEW`` on, their list is broadcast
    (10**13 rows have ten million keys at most); with smaller ``hot_rows`` Spark decides by its size.
    """
    salts = (F.col(size_col) / F.lit(hot_rows)).cast("int") + 1
    hot = facts.filter(F.col(size_col) > hot_rows).select(F.col(on), salts.alias("__salts"))
    salted_rows = (
        rows.join(F.broadcast(hot) if hot_rows >= SURELY_FEW else hot, on, "left")
        .withColumn("__salt", F.coalesce(F.pmod(row_hash, F.col("__salts")), F.lit(0)).cast("int"))
        .drop("__salts")
    )
    spread = F.when(F.col(size_col) > hot_rows, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    salted_facts = facts.withColumn("__salt", F.explode(spread))
    return salted_rows.join(salted_facts, [on, "__salt"], how).drop("__salt")
