"""Streams of log records.

Event time must be TIMESTAMP: NTZ columns are cast under the session time zone.  Filters and rule
tags need nothing here: ``filter_logs`` and ``tag_matches`` work on streams as they are.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions.buckets import CALENDAR_UNITS, step_seconds
from loglattice.functions.fields import Scope, quoted
from loglattice.operators.explore import row_key
from loglattice.plans.durable import written
from loglattice.sources.logs import with_partition_column
from loglattice.view import LogView

TRIGGER = "5 seconds"


def stream_logs(
    spark: SparkSession, path: str, schema, format: str = "parquet", batch_files: int | None = None, batch_bytes: str | None = None, **options
) -> DataFrame:
    """Log files arriving in a folder; a batch takes at most ``batch_files`` files, or files of about ``batch_bytes`` ("1g")."""
    if batch_files is not None:
        options["maxFilesPerTrigger"] = batch_files
    if batch_bytes is not None:
        options["maxBytesPerTrigger"] = batch_bytes
    return spark.readStream.schema(schema).format(format).options(**options).load(path)


def ingest(
    stream: DataFrame, path: str, checkpoint: str, view: LogView | None = None, by: str = "day", trigger: dict | None = None,
    format: str = "parquet", partition_name: str = "event_date",
):
    """Append a stream to a table folder, every five seconds unless told otherwise.

    With a ``view`` the table is partitioned by the timestamp's day or hour, as ``write_logs`` does, so that
    it prunes like any other.  Each file appears once, also after a restart.
    """
    rows = stream
    if view is not None:
        rows = with_partition_column(stream, view, by, partition_name)
    writer = rows.writeStream.format(format).outputMode("append").option("checkpointLocation", checkpoint)
    if view is not None:
        writer = writer.partitionBy(partition_name)
    return writer.trigger(**(trigger or {"processingTime": TRIGGER})).start(path)


def event_time(stream: DataFrame, view: LogView) -> DataFrame:
    """The timestamp role as TIMESTAMP."""
    view.require("timestamp")
    if isinstance(stream.schema[view.timestamp].dataType, T.TimestampType):
        return stream
    return stream.withColumn(view.timestamp, quoted(view.timestamp).cast("timestamp"))


def stream_volume(
    stream: DataFrame, view: LogView, interval: str | int = "minute", late: str = "10 minutes", by: str | None = "severity"
) -> DataFrame:
    """(time, level, count) with state dropped once ``late`` has passed."""
    if interval in CALENDAR_UNITS:
        raise ValueError("streams are counted over fixed-width buckets")
    rows = event_time(stream, view)
    if by is None:
        level = F.lit("")
    elif by == "severity" and view.severity:
        level = F.coalesce(Scope(rows, view).get(view.severity).field.as_string(), F.lit("unknown"))
    else:
        level = Scope(rows, view).get(by).field.as_string()
    w = F.window(quoted(view.timestamp), f"{step_seconds(interval)} seconds")
    counts = (
        rows.select(quoted(view.timestamp), level.alias("level"))
        .withWatermark(view.timestamp, late)
        .groupBy(w, "level")
        .agg(F.count("*").alias("count"))
    )
    return counts.select(F.col("window.start").alias("time"), "level", "count")


def stream_top_values(
    stream: DataFrame, view: LogView, field: str, window: str = "10 minutes", slide: str = "1 minute", late: str = "10 minutes"
) -> DataFrame:
    """(window_start, window_end, value, count) over sliding windows; rank with :func:`rank_windows`."""
    rows = event_time(stream, view)
    value = Scope(rows, view).get(field).field.as_string().alias("value")
    counts = (
        rows.select(quoted(view.timestamp), value)
        .filter(F.col("value").isNotNull() & ~F.col("value").isin("", "{}", "[]", "null"))
        .withWatermark(view.timestamp, late)
        .groupBy(F.window(quoted(view.timestamp), window, slide), "value")
        .agg(F.count("*").alias("count"))
    )
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "value", "count")


def rank_windows(counts: DataFrame, limit: int = 10) -> DataFrame:
    """Top values of each window of a (batch) frame of window counts."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("window_start").orderBy(F.desc("count"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def _merge_ranks(batch: DataFrame, path: str, limit: int) -> None:
    """Takes the counts that a batch changed into the counts kept, and ranks the windows of their days anew."""
    spark = batch.sparkSession
    batch = written(batch.withColumn("day", F.floor(F.unix_seconds("window_start") / 86400)), "ranks-batch")
    touched = batch.select("day").distinct()
    try:
        kept = spark.read.schema(batch.schema).parquet(f"{path}/counts")
        batch = batch.unionByName(kept.join(touched, "day", "left_semi"))  # only their folders are read
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    # a count only grows while its window is open, so a batch that comes again changes nothing
    merged = batch.groupBy("day", "window_start", "window_end", "value").agg(F.max("count").alias("count"))
    merged = written(merged, "ranks-merged")
    for rows, name in ((rank_windows(merged, limit), "ranks"), (merged, "counts")):
        writer = rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("day").parquet(f"{path}/{name}")


def rank_stream(counts: DataFrame, path: str, checkpoint: str, limit: int = 10, trigger: dict | None = None):
    """Keep the top values of each window of :func:`stream_top_values` ranked while the stream runs.

    Every batch rewrites the days that have a window it touches, a folder a day, and no others; read the ranks with
    :func:`read_ranks`.  The counts kept beside them are absolute, so a batch run again changes nothing.
    """
    writer = counts.writeStream.foreachBatch(lambda batch, _: _merge_ranks(batch, path, limit))
    writer = writer.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": TRIGGER})).start()


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """(window_start, window_end, value, count, rank) as the last batch left them."""
    return spark.read.parquet(f"{path}/ranks").drop("day")


def stream_dedupe(stream: DataFrame, view: LogView, late: str = "10 minutes") -> DataFrame:
    """Drop repeats of a content key that arrive within the watermark."""
    rows = event_time(stream, view)
    keyed = rows.withColumn("row_key", row_key(rows, view)).withWatermark(view.timestamp, late)
    return keyed.dropDuplicatesWithinWatermark(["row_key"])


def stream_correlate(
    spans: DataFrame,
    qlog: DataFrame,
    late: str = "30 seconds",
    start: str = "start_time",
    logged: str = "event_time",
) -> DataFrame:
    """Spans left-joined to the query-log row that arrives up to ``late`` after the span started.

    ``spans`` has root_id, id and a start time; ``qlog`` trace_id, span_id and an event time.  Of
    several log rows for one span the first to arrive counts.  Unmatched spans come out once both
    watermarks have passed.
    """
    left = spans.withWatermark(start, late)
    right = qlog.withWatermark(logged, late).dropDuplicatesWithinWatermark(["trace_id", "span_id"])
    near = (
        (F.col("trace_id") == F.col("root_id"))
        & (F.col("span_id") == F.col("id"))
        & (quoted(logged) >= quoted(start))
        & (quoted(logged) <= quoted(start) + F.expr(f"interval {late}"))
    )
    return left.join(right, near, "leftOuter")
