"""Rows side by side, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions.fields import Scope, quoted
from loglattice.operators.flatten import column_entries
from loglattice.plans.joins import BROADCAST_ROWS
from loglattice.view import LogView


def _long(df: DataFrame, view: LogView, keep: list[str]) -> DataFrame:
    """(keep…, field, value): one row per row and field, from one pass over the table."""
    entries = [e for name, e in column_entries(df, view) if name not in keep]
    return df.select(*[quoted(k) for k in keep], F.inline(F.array(*entries)))


def compare_rows(df: DataFrame, view: LogView, ref: Column, row_id: str | None = None) -> DataFrame:
    """Each field of each row, flagged equal or different to the same field of the reference row.

    ``ref`` is a condition naming the reference row.  ``field_order`` puts the timestamp first and
    the rest in alphabetical order.  The reference side has one row per field of the schema.
    """
    rid = row_id or (view.row_id[0] if view.row_id else None)
    if rid is None:
        raise ValueError("comparing rows needs a row id column")
    long = _long(df, view, [rid])
    reference = _long(df.filter(ref).orderBy(quoted(rid)).limit(1), view, [rid]).select(
        F.col("key").alias("field"), F.col("value").alias("ref_value")
    )
    if len(df.columns) <= BROADCAST_ROWS:
        reference = F.broadcast(reference)
    ordered = sorted((c for c in df.columns if c != rid), key=lambda c: (c != view.timestamp, c))
    rank = F.array_position(F.array(*[F.lit(c) for c in ordered]), F.col("field")).cast("int")
    return (
        long.select(quoted(rid), F.col("key").alias("field"), "value")
        .join(reference, "field")
        .select(
            quoted(rid),
            "field",
            rank.alias("field_order"),
            "value",
            F.col("value").eqNullSafe(F.col("ref_value")).alias("same"),
        )
    )


def _digest(value: Column) -> Column:
    """Stands for the value when only equality matters; long text is not carried through a shuffle."""
    return F.when(F.octet_length(value) > 32, F.sha2(value, 256)).otherwise(value)


def diff_within(df: DataFrame, view: LogView, by: str) -> DataFrame:
    """Per group and field, how many different values (NULL counts as one) the group holds.

    Distinct values are found first, over (group, field, value), so a very large group is spread
    over many tasks before its values are counted.  A value over 32 bytes is its SHA-256 there (no
    shorter value can read like one).
    """
    Scope(df, view).get(by)
    long = _long(df, view, [by]).withColumnRenamed("key", "field")
    distinct = long.groupBy(quoted(by), "field", _digest(F.col("value")).alias("value")).agg(F.count("*").alias("n"))
    return distinct.groupBy(quoted(by), "field").agg(
        F.count("*").alias("n_values"),
        F.sum("n").alias("n_rows"),
        (F.count("*") > 1).alias("differs"),
    )
