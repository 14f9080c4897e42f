"""Streaming operators, run over a given table up to its present end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.catalog.common import ATTR_EVENTS, ATTR_EVENTS_SQL, EVENTS, PREFIX
from loglattice.catalog.search import RULES, RULES_SQL
from loglattice.catalog.tables import SQL as TABLES_SQL, _flat, payloads
from loglattice.operators import predicates as P
from loglattice.operators.predicates import filter_logs
from loglattice.operators.rules import tag_matches
from loglattice.plans.durable import scratch_path
from loglattice.sources.live import compact, read_live
from loglattice.sources.logs import read_logs
from loglattice.sources.otlp import otlp_logs
from loglattice.view import LogView
from loglattice.streaming.status import STATE_STORE, stream_status
from loglattice.streaming.streams import (
    event_time, ingest, rank_stream, rank_windows, read_ranks, stream_correlate, stream_dedupe, stream_logs, stream_top_values, stream_volume,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def arriving(s, d, name="events"):
    """A given table as a stream of files."""
    schema = s.read.parquet(f"{d}/{name}.parquet").schema
    return stream_logs(s, d, schema, pathGlobFilter=f"{name}.parquet")


def drain_append(stream: DataFrame, label: str) -> DataFrame:
    """Run an append-mode stream over what is there now and read the result back as a table."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", state).trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, keys: list[str], value: str, label: str) -> DataFrame:
    """Run an update-mode aggregate over what is there now and read back the last value of each key."""
    log = drain_all_updates(stream, label)
    return log.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def drain_all_updates(stream: DataFrame, label: str) -> DataFrame:
    """Run an update-mode stream over what is there now and read back every row it gave, with its batch.

    Each batch is written under its own number, so a batch run again overwrites itself.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(save).outputMode("update")
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)


def _ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


FROM, TO = "2024-01-10 18:00:00", "2024-01-11 07:00:00"


def _ingested(s, d):
    """Events streamed into a partitioned table, read back over a time range."""
    out, state = scratch_path(s, "ingest"), scratch_path(s, "ingest-state")
    ingest(arriving(s, d), out, state, EVENTS, trigger={"availableNow": True}).awaitTermination()
    view = EVENTS.with_(partition_col="event_date", partition_by="day")
    return filter_logs(read_logs(s, out), view, P.time_range(FROM, TO)).drop("event_date")


QUERIES["src_stream"] = _ingested
SQL["src_stream"] = f"SELECT * FROM events WHERE ts >= TIMESTAMP '{FROM}' AND ts <= TIMESTAMP '{TO}'"



def _compacted(s, d):
    """Events arriving in small files, ingested at most three files a batch; the table is packed while the ingest goes on."""
    source, out, state = (scratch_path(s, f"ingest-{x}") for x in ("source", "table", "state"))
    given = s.read.parquet(f"{d}/events.parquet")
    view = EVENTS.with_(partition_col="event_date", partition_by="day")
    for odd in (0, 1):
        given.filter(F.col("event_id") % 2 == odd).repartition(6).write.mode("append").parquet(source)
        arrived = stream_logs(s, source, given.schema, batch_files=3)
        ingest(arrived, out, state, EVENTS, trigger={"availableNow": True}).awaitTermination()
        if odd == 0:
            compact(s, out, view)
    compact(s, out, view)
    return read_live(s, out).drop("event_date")


QUERIES["src_compact"] = _compacted
SQL["src_compact"] = "SELECT * FROM events"


def _collected(s, d):
    """Requests arriving as lines of text, shredded and ingested by day, then searched over a time range."""
    source, out, state = (scratch_path(s, f"otlp-{x}") for x in ("source", "table", "state"))
    payloads(s, d).repartition(4).write.text(source)
    logs = otlp_logs(stream_logs(s, source, "value string", format="text", batch_files=2))
    view = LogView.otel()
    ingest(logs, out, state, view, trigger={"availableNow": True}).awaitTermination()
    view = view.with_(partition_col="event_date", partition_by="day")
    return _flat(filter_logs(read_logs(s, out), view, P.time_range(FROM, TO)))


QUERIES["st_otlp"] = _collected
SQL["st_otlp"] = f"SELECT * FROM ({TABLES_SQL['src_otlp_logs']}) WHERE ts >= TIMESTAMP '{FROM}' AND ts <= TIMESTAMP '{TO}'"

QUERIES["st_volume"] = lambda s, d: _ntz(
    drain_updates(stream_volume(arriving(s, d), EVENTS, "hour"), ["time", "level"], "count", "volume"), "time"
)
SQL["st_volume"] = """SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS time, event_type AS level, count(*) AS count
  FROM events GROUP BY 1, 2"""

QUERIES["st_filter"] = lambda s, d: drain_append(
    filter_logs(arriving(s, d), EVENTS, P.gt("value", 40) & ~P.eq("event_type", "view") & P.gte("props.k", 50)), "tail"
)
SQL["st_filter"] = """SELECT * FROM events WHERE value > 40 AND event_type <> 'view' AND TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50"""

LIVE_RULES = {"errors": P.eq("event_type", "error"), "large": P.gt("value", 100), "k42": P.eq("props.k", 42)}
QUERIES["st_tag"] = lambda s, d: drain_append(
    tag_matches(arriving(s, d), EVENTS, LIVE_RULES).select("event_id", F.array_join("rules", ",").alias("rules")), "tags"
)
SQL["st_tag"] = """SELECT event_id, concat_ws(',', CASE WHEN event_type = 'error' THEN 'errors' END, CASE WHEN value > 100 THEN 'large' END,
  CASE WHEN json_extract_string(props, '$.k') = '42' THEN 'k42' END) AS rules FROM events"""


def _top(s, d):
    counts = stream_top_values(arriving(s, d), EVENTS, "event_type", "2 hours", "1 hour")
    keys = ["window_start", "window_end", "value"]
    return _ntz(rank_windows(drain_updates(counts, keys, "count", "top"), 2), "window_start", "window_end")


QUERIES["st_topvalues"] = _top
SQL["st_topvalues"] = """
  WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') - o * INTERVAL 1 HOUR AS window_start, event_type AS value
             FROM events CROSS JOIN (VALUES (0), (1)) AS c(o)),
  c AS (SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, value, count(*) AS count FROM w GROUP BY ALL)
  SELECT window_start, window_end, value, count, CAST(rank AS INTEGER) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY count DESC, value) AS rank FROM c) WHERE rank <= 2"""


def _in_pieces(s, d, pieces=6):
    """Events as files that arrive two a batch."""
    source = scratch_path(s, "pieces")
    given = s.read.parquet(f"{d}/events.parquet")
    given.repartition(pieces, "event_id").write.parquet(source)
    return stream_logs(s, source, given.schema, batch_files=2)


def _ranked(s, d):
    """Ranks kept while the stream runs."""
    counts = stream_top_values(_in_pieces(s, d), EVENTS, "event_type", "2 hours", "1 hour", late="60 days")
    out, state = scratch_path(s, "ranks"), scratch_path(s, "ranks-state")
    rank_stream(counts, out, state, 2, trigger={"availableNow": True}).awaitTermination()
    return _ntz(read_ranks(s, out), "window_start", "window_end")


QUERIES["st_topvalues_live"] = _ranked
SQL["st_topvalues_live"] = SQL["st_topvalues"]


def _statuses(s, d):
    """Views are roots, purchases without a tag; the next event of the id sequence is a log row when it is an error or a click."""
    e = event_time(arriving(s, d), EVENTS)
    roots = e.filter(F.col("event_type").isin("view", "purchase")).select(
        F.col("event_id").alias("root_id"), F.col("ts").alias("start_time"), (F.col("event_type") == "view").alias("tagged")
    )
    q = event_time(arriving(s, d), EVENTS).filter(F.col("event_type").isin("error", "click"))
    log = q.select((F.col("event_id") - 1).alias("trace_id"), F.col("ts").alias("event_time"))
    before = s.conf.get("spark.sql.streaming.stateStore.providerClass")
    s.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        changes = stream_status(roots, log, budget_seconds=300, late="1 minute", tagged=F.col("tagged"))
        out = drain_all_updates(changes, "status")
    finally:
        s.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return out.select("root_id", "status", "n_log_rows", "settled")


QUERIES["st_status"] = _statuses
#: Every root is pending, or ok if its row came in the same batch; behind the final watermark, a minute behind the earlier end
#: of both streams, it is settled.
SQL["st_status"] = """
  WITH r AS (SELECT a.event_id AS root_id, a.event_type = 'view' AS tagged, a.ts, count(b.event_id) AS n FROM events a
             LEFT JOIN events b ON b.event_id = a.event_id + 1 AND b.event_type IN ('error', 'click')
             WHERE a.event_type IN ('view', 'purchase') GROUP BY ALL),
  w AS (SELECT least(max(ts) FILTER (event_type IN ('view', 'purchase')), max(ts) FILTER (event_type IN ('error', 'click'))) - INTERVAL 1 MINUTE AS mark FROM events)
  SELECT root_id, CASE WHEN tagged THEN CASE WHEN n > 0 THEN 'ok' ELSE 'pending' END ELSE 'not-tagged' END AS status,
         CASE WHEN tagged THEN n ELSE 0 END AS n_log_rows, NOT tagged AS settled FROM r
  UNION ALL
  SELECT root_id, CASE WHEN n > 0 THEN 'ok' ELSE 'no-data' END, n, TRUE FROM r, w WHERE tagged AND ts + INTERVAL 5 MINUTE <= mark"""


def _dedupe(s, d):
    """Timestamps cut to six hours, so users repeat content keys."""
    rows = arriving(s, d).withColumn("ts", F.date_trunc("day", "ts"))
    return drain_append(stream_dedupe(rows, EVENTS, "60 days").select("event_type", "user_id", "ts"), "dedupe")


QUERIES["st_dedupe"] = lambda s, d: _ntz(_dedupe(s, d), "ts")
SQL["st_dedupe"] = "SELECT DISTINCT event_type, user_id, date_trunc('day', ts) AS ts FROM events"


def _all_spans(s, d):
    """Views are spans; the next event of the id sequence is its log row when it is no view itself."""
    e = event_time(arriving(s, d), EVENTS)
    spans = e.filter(F.col("event_type") == "view").select(F.lit("t").alias("root_id"), F.col("event_id").alias("id"), F.col("ts").alias("start_time"))
    q = event_time(arriving(s, d), EVENTS).filter(F.col("event_type") != "view")
    log = q.select(
        F.lit("t").alias("trace_id"), (F.col("event_id") - 1).alias("span_id"), F.col("ts").alias("event_time"), F.col("value").alias("duration")
    )
    joined = stream_correlate(spans, log, late="5 minutes")
    out = drain_append(joined.select("id", "start_time", "event_time", "duration"), "correlate")
    return _ntz(out, "start_time", "event_time")


def _correlate(s, d):
    """The spans that have a log row."""
    return _all_spans(s, d).filter(F.col("event_time").isNotNull())


QUERIES["st_correlate"] = _correlate
SQL["st_correlate"] = """
  SELECT a.event_id AS id, a.ts AS start_time, b.ts AS event_time, b.value AS duration
  FROM events a JOIN events b ON b.event_id = a.event_id + 1
  WHERE a.event_type = 'view' AND b.event_type <> 'view' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 5 MINUTE"""

#: Also the spans without a log row, as far as the stream has given them up: behind the final watermark, which is five
#: minutes behind the earlier of the last span and the last log row, less the five minutes in which a log row may come.
QUERIES["st_correlate_outer"] = _all_spans
SQL["st_correlate_outer"] = """
  WITH w AS (SELECT least(max(ts) FILTER (event_type = 'view'), max(ts) FILTER (event_type <> 'view')) - INTERVAL 10 MINUTE AS closed FROM events)
  SELECT a.event_id AS id, a.ts AS start_time, b.ts AS event_time, b.value AS duration
  FROM events a CROSS JOIN w LEFT JOIN events b
    ON b.event_id = a.event_id + 1 AND b.event_type <> 'view' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 5 MINUTE
  WHERE a.event_type = 'view' AND (b.event_id IS NOT NULL OR a.ts < w.closed)"""
