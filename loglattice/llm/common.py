"""Small helpers that the operators share."""

from __future__ import annotations

import os
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shipped(df: DataFrame) -> DataFrame:
    """``df``, once its cluster's Python workers can import this package (code only, by addPyFile)."""
    sc = df.sparkSession.sparkContext
    if getattr(sc, "_loglattice_shipped", None) is None:
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        name = os.path.join(tempfile.mkdtemp(prefix="loglattice-code-"), "loglattice")
        sc.addPyFile(shutil.make_archive(name, "zip", top, "loglattice"))
        sc._loglattice_shipped = True
    return df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def whole(c: Column | str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def row_digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a role and a text."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def table_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def successors(keys: DataFrame, key: str, out: str, depth: int = 2) -> DataFrame:
    """For each distinct long ``key`` the next larger one (null for the largest).

    A window over all keys would run in one task.  Keys are cut into ranges of 65,536 instead; the
    last key of a range takes the first key of the next range that exists, found the same way.  Two
    levels leave at most 2**32 / 65,536 of every 2**48 keys to the window at the top.
    """
    rows = keys.select(F.col(key).alias("__k")).distinct()
    if depth == 0:
        return rows.select(F.col("__k").alias(key), F.lead("__k").over(Window.orderBy("__k")).alias(out))
    rows = rows.withColumn("__g", F.shiftright("__k", 16))
    firsts = rows.groupBy("__g").agg(F.min("__k").alias("__first"))
    nexts = successors(firsts, "__g", "__next", depth - 1)
    edge = nexts.join(firsts.withColumnRenamed("__g", "__next"), "__next").select("__g", F.col("__first").alias("__edge"))
    lead = F.lead("__k").over(Window.partitionBy("__g").orderBy("__k"))
    return (
        rows.withColumn("__n", lead)
        .join(edge, "__g", "left")
        .select(F.col("__k").alias(key), F.coalesce("__n", "__edge").alias(out))
    )
