"""Log tables in and out: reads, SQL with time macros, partitioned writes, retention."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions.coarse import coarse_column, coarse_literal
from loglattice.functions.fields import Scope, quoted
from loglattice.functions.literals import naive_utc
from loglattice.plans.durable import filesystem
from loglattice.view import LogView

# The macros a query may use for the bounds of the time range.
FROM_MACRO = "$__fromTime"
TO_MACRO = "$__toTime"
RETENTION_DAYS = 30


def read_logs(spark: SparkSession, source: str, format: str = "parquet", schema=None, **options) -> DataFrame:
    """A logs table by catalog name (``db.table``) or by path."""
    if "/" not in source and spark.catalog.tableExists(source):
        return spark.table(source)
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(source)


def run_sql(spark: SparkSession, sql: str, from_=None, to=None, **tables: DataFrame) -> DataFrame:
    """Free SQL; the time macros are bound as timestamp parameters, DataFrames by name as ``{name}``."""
    args = {}
    for macro, name, value in ((FROM_MACRO, "from_time", from_), (TO_MACRO, "to_time", to)):
        if macro in sql:
            if value is None:
                raise ValueError(f"the query uses {macro} but no bound was given")
            sql = sql.replace(macro, f":{name}")
            args[name] = naive_utc(value).replace(tzinfo=dt.timezone.utc)
    return spark.sql(sql, args=args, **tables) if args else spark.sql(sql, **tables)


def with_partition_column(df: DataFrame, view: LogView, by: str = "day", name: str = "event_date") -> DataFrame:
    """Adds the timestamp's UTC day as a DATE, or its UTC hour as hours since 1970."""
    if by not in ("day", "hour"):
        raise ValueError("tables are partitioned by 'day' or 'hour'")
    scope = Scope(df, view)
    kind = T.DateType() if by == "day" else T.LongType()
    return df.withColumn(name, coarse_column(scope.role("timestamp"), scope.role_type("timestamp"), by, kind))


def write_logs(
    df: DataFrame,
    path: str,
    view: LogView,
    by: str = "day",
    mode: str = "append",
    partition_name: str = "event_date",
    bloom: Sequence[str] = (),
    bloom_ndv: int = 1_000_000,
    format: str = "parquet",
    tokens: bool = False,
) -> LogView:
    """Write partitioned by a truncation of the timestamp and sorted by (service, time) inside files.

    Rows are range partitioned by (partition, service, time, reading task): a day holding most of the
    data is spread over many tasks and files, each with a narrow service/time range for file
    statistics to skip on, while small days share a task.  The reading task comes last so that even
    rows of one instant can be split.  Columns in ``bloom`` get Parquet bloom filters for
    equality lookups; with ``tokens`` the new files get filters of the body's words for
    ``tokens.search_logs``.  Returns the view that also filters the partition column.
    """
    view.require("timestamp")
    parted = with_partition_column(df, view, by, partition_name)
    order = [partition_name] + [c for c in (view.service, view.timestamp) if c]
    cols = [quoted(c) for c in order]
    tasked = parted.withColumn("__task", F.spark_partition_id())
    ranged = tasked.repartitionByRange(*cols, "__task").drop("__task").sortWithinPartitions(*cols)
    writer = ranged.write.mode(mode).format(format)
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{c}", str(bloom_ndv))
    writer.partitionBy(partition_name).save(path)
    out = view.with_(partition_col=partition_name, partition_by=by)
    if tokens:
        from loglattice.sources.tokens import index_tokens

        index_tokens(df.sparkSession, path, out)
    return out


def apply_retention(df: DataFrame, view: LogView, now, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows not older than ``days`` before ``now``; whole partitions are skipped where possible."""
    from loglattice.operators.predicates import filter_logs, time_range

    return filter_logs(df, view, time_range(naive_utc(now) - dt.timedelta(days=days), None))


def drop_expired(spark: SparkSession, path: str, view: LogView, now, days: int = RETENTION_DAYS, format: str = "parquet") -> list:
    """Removes the partition folders that hold only expired rows; returns their values."""
    df = spark.read.format(format).load(path)
    gone = sorted(r[0] for r in expired_partitions(df, view, now, days).collect())
    for value in gone:
        fs, name = filesystem(f"{path.rstrip('/')}/{view.partition_col}={value}")
        fs.delete_dir(name)
    return gone


def expired_partitions(df: DataFrame, view: LogView, now, days: int = RETENTION_DAYS) -> DataFrame:
    """Partition values that hold only expired rows and may be dropped."""
    if not view.partition_col:
        raise ValueError("the view names no partition column")
    cut = naive_utc(now) - dt.timedelta(days=days)
    col = Scope(df, view).get(view.partition_col)
    old = col.column < coarse_literal(cut, view.partition_by, col.dtype)
    return df.filter(old).select(col.column.alias(view.partition_col)).distinct()
