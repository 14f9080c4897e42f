"""What is in the table: frequent values, map keys, JSON paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loglattice.functions.fields import Scope, quoted
from loglattice.operators.flatten import as_variant, depth_of, with_leaves
from loglattice.operators.predicates import Predicate, filter_logs
from loglattice.plans.topk import bounded_by_time
from loglattice.view import LogView

SAMPLE = 500
# Texts that stand for "nothing here".
EMPTY_TEXTS = ("", "{}", "[]", "null")


def newest(df: DataFrame, view: LogView, sample: int | None, where: Predicate | None = None) -> DataFrame:
    """The newest ``sample`` matching rows; all of them when ``sample`` is None."""
    rows = filter_logs(df, view, where) if where is not None else df
    if sample is None:
        return rows
    if view.timestamp:
        rows = bounded_by_time(rows, view, sample)
        ties = [quoted(r).asc_nulls_last() for r in view.row_id]
        rows = rows.orderBy(Scope(rows, view).role("timestamp").desc_nulls_last(), *ties)
    return rows.limit(sample)


def _kept(value: Column) -> Column:
    return value.isNotNull() & ~value.isin(*EMPTY_TEXTS)


def top_values(
    df: DataFrame,
    view: LogView,
    field: str,
    limit: int = 10,
    sample: int | None = SAMPLE,
    where: Predicate | None = None,
) -> DataFrame:
    """(value, count, total, pct) of a field's most frequent values in the newest rows.

    ``total`` counts the rows whose value is present.  With ``sample=None`` the whole table is
    counted; the total is then a scalar over the same aggregate, not a window in one task.
    """
    rows = newest(df, view, sample, where)
    value = Scope(rows, view).get(field).field.as_string().alias("value")
    counts = rows.select(value).filter(_kept(F.col("value"))).groupBy("value").agg(F.count("*").alias("count"))
    if sample is not None:  # at most ``sample`` groups, so one task may see them all
        totalled = counts.withColumn("total", F.sum("count").over(Window.partitionBy()))
    else:
        totalled = counts.withColumn("total", counts.agg(F.sum("count")).scalar())
    top = totalled.orderBy(F.desc("count"), F.asc("value")).limit(limit)
    return top.withColumn("pct", F.col("count") * 100.0 / F.col("total"))


def profile(
    df: DataFrame,
    view: LogView,
    fields: Sequence[str] | None = None,
    limit: int = 10,
    sample: int | None = None,
    where: Predicate | None = None,
) -> DataFrame:
    """(field, value, count, total, rank): the most frequent values of every leaf field, in one job.

    Every row becomes one pair per field and is counted before it is shuffled; the ranking keeps
    ``limit`` values per field in each task before they meet.
    """
    rows = newest(df, view, sample, where)
    scope = Scope(rows, view)
    chosen = [scope.get(f).field for f in fields] if fields else [f for f in scope.fields if f.semantic not in ("map", "array", "json")]
    pairs = F.array(*[F.struct(F.lit(f.display).alias("field"), f.as_string().alias("value")) for f in chosen])
    long = rows.select(F.inline(pairs)).filter(_kept(F.col("value")))
    counts = long.groupBy("field", "value").agg(F.count("*").alias("count"))
    totals = counts.groupBy("field").agg(F.sum("count").alias("total"))
    w = Window.partitionBy("field").orderBy(F.desc("count"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    # both sides have at most (fields x limit) rows
    return ranked.join(totals, "field").select("field", "value", "count", "total", "rank")


def map_keys(
    df: DataFrame, view: LogView, column: str, sample: int | None = SAMPLE, where: Predicate | None = None
) -> DataFrame:
    """(key, total): distinct keys of a map column in the newest rows, and how many rows were looked at."""
    rows = newest(df, view, sample, where).select(quoted(column).alias("m"))
    counted = rows.select(F.explode(F.map_keys("m")).alias("key")).distinct()
    return counted.withColumn("total", rows.agg(F.count("*")).scalar())


def map_key_counts(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """(key, count): rows of the whole table holding each key."""
    rows = df.filter(where) if where is not None else df
    return rows.select(F.explode(F.map_keys(quoted(column))).alias("key")).groupBy("key").agg(F.count("*").alias("count"))


def json_paths(df: DataFrame, column: str, max_depth: int | None = None) -> DataFrame:
    """(path, type, count): every leaf path of a JSON column over the whole table.

    Types of one path merge as Spark merges VARIANT schemas.  Leaves are counted inside each task
    first, so what is shuffled is one row per path and task.  Objects are opened as deep as the data
    goes, unless ``max_depth`` says where to stop.
    """
    max_depth = depth_of(df, column) if max_depth is None else max_depth
    opened = with_leaves(df, "__leaves", as_variant(quoted(column), df.schema[column].dataType), max_depth)
    return (
        opened.select(F.inline("__leaves"))
        .groupBy("path")
        .agg(F.schema_of_variant_agg("value").alias("type"), F.count("*").alias("count"))
    )


def json_schema(df: DataFrame, column: str) -> DataFrame:
    """One row: the merged type of the whole column."""
    v = as_variant(quoted(column), df.schema[column].dataType)
    return df.agg(F.schema_of_variant_agg(v).alias("type"))


def semantic_fields(df: DataFrame, view: LogView) -> DataFrame:
    """(name, display, source, type) of every field, from the schema alone."""
    rows = [(f.name, f.display, f.source, f.semantic) for f in Scope(df, view).fields]
    return df.sparkSession.createDataFrame(rows, "name string, display string, source string, type string")
