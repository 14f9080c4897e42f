"""Traces and span trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.catalog.common import ORDER_SPANS_SQL, SPANS_SQL, TURNS, order_spans, spans, table
from loglattice.operators.traces import (
    action_summary, collapse_runs, join_logs_traces, logs_of_trace, otel_spans, phase_breakdown, span_tree, trace_windows, tree_end, waterfall,
)
from loglattice.view import LogView

QUERIES: dict = {}
SQL: dict[str, str] = {}
USER_LOGS = LogView(timestamp="ts", severity="event_type", trace_id="user_id", row_id=("event_id",))

QUERIES["trace_filter"] = lambda s, d: logs_of_trace(table(s, d, "events"), USER_LOGS, "42")
SQL["trace_filter"] = "SELECT * FROM events WHERE user_id = 42"

# purchases are the spans of a user's trace
BUYS_SQL = "SELECT user_id AS trace_id, ts AS start, ts + (event_id % 90) * INTERVAL 1 SECOND AS \"end\" FROM events WHERE event_type = 'purchase'"


def buys(s, d):
    e = table(s, d, "events").filter(F.col("event_type") == "purchase")
    return e.select(
        F.col("user_id").alias("trace_id"),
        F.col("ts").alias("start"),
        (F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 90)).alias("end"),
    )


WINDOWS_SQL = f"""SELECT trace_id, min(start) - INTERVAL 5 MINUTE AS window_start, max("end") + INTERVAL 5 MINUTE AS window_end,
  count(*) AS n_rows FROM ({BUYS_SQL}) GROUP BY trace_id"""
QUERIES["trace_window"] = lambda s, d: trace_windows(buys(s, d))
SQL["trace_window"] = WINDOWS_SQL
JOIN_SQL = f"SELECT e.*, w.trace_id, w.window_start, w.window_end FROM events e JOIN ({WINDOWS_SQL}) w ON e.user_id = w.trace_id AND e.ts BETWEEN w.window_start AND w.window_end"
QUERIES["trace_logs_join"] = lambda s, d: join_logs_traces(table(s, d, "events"), USER_LOGS, trace_windows(buys(s, d)))
SQL["trace_logs_join"] = JOIN_SQL
# the same join with every trace treated as too large for one task
QUERIES["trace_logs_join_salted"] = lambda s, d: join_logs_traces(table(s, d, "events"), USER_LOGS, trace_windows(buys(s, d)), hot_rows=20)
SQL["trace_logs_join_salted"] = JOIN_SQL

QUERIES["span_flatten"] = lambda s, d: span_tree(spans(s, d)).select(
    "id", "root_id", "depth", F.array_join(F.transform("path", lambda p: p["id"].cast("string")), ">").alias("path")
)
SQL["span_flatten"] = f"""
  WITH RECURSIVE sp AS ({SPANS_SQL}), walk AS (
    SELECT id, root_id, 0 AS depth, '' AS path FROM sp WHERE parent_id IS NULL
    UNION ALL SELECT c.id, c.root_id, w.depth + 1, CASE WHEN w.path = '' THEN '' ELSE w.path || '>' END || CAST(c.id AS VARCHAR)
    FROM walk w JOIN sp c ON c.parent_id = w.id)
  SELECT * FROM walk"""

# ids that come again in every tree, '' for no parent, and parents that never arrived
LOCAL_SQL = f"""SELECT id % 64 AS id, CASE WHEN id = root_id THEN '' ELSE CAST(CASE WHEN id % 640 = 70 THEN 9999 ELSE parent_id % 64 END AS VARCHAR) END AS parent_id,
  root_id, start_ms, end_ms, kind, status FROM ({SPANS_SQL})"""


def local_spans(s, d):
    t = spans(s, d)
    parent = F.when(F.col("id") % 640 == 70, F.lit(9999)).otherwise(F.col("parent_id") % 64).cast("string")
    return t.select(
        (F.col("id") % 64).alias("id"), F.when(F.col("id") == F.col("root_id"), "").otherwise(parent).alias("parent_id"),
        "root_id", "start_ms", "end_ms", "kind", "status",
    )


QUERIES["span_flatten_local"] = lambda s, d: span_tree(local_spans(s, d), order=["id"]).select(
    "id", "root_id", "depth", F.array_join(F.transform("path", lambda p: p["id"].cast("string")), ">").alias("path"), "reachable"
)
SQL["span_flatten_local"] = f"""
  WITH RECURSIVE sp AS ({LOCAL_SQL}), walk AS (
    SELECT id, root_id, 0 AS depth, '' AS path FROM sp WHERE parent_id = ''
    UNION ALL SELECT c.id, c.root_id, w.depth + 1, CASE WHEN w.path = '' THEN '' ELSE w.path || '>' END || CAST(c.id AS VARCHAR)
    FROM walk w JOIN sp c ON c.parent_id = CAST(w.id AS VARCHAR) AND c.root_id = w.root_id)
  SELECT sp.id, sp.root_id, w.depth, w.path, w.id IS NOT NULL AS reachable FROM sp LEFT JOIN walk w USING (root_id, id)"""
QUERIES["waterfall_local"] = lambda s, d: waterfall(local_spans(s, d)).select("id", "root_id", "duration_ms", "total_ms")
SQL["waterfall_local"] = f"""
  WITH sp AS ({LOCAL_SQL}), f AS (SELECT root_id, max(CASE WHEN parent_id = '' THEN start_ms END) AS rs,
       CASE WHEN count(*) = count(end_ms) THEN max(end_ms) END AS te FROM sp GROUP BY root_id)
  SELECT id, root_id, CASE WHEN end_ms IS NOT NULL THEN greatest(end_ms - start_ms, 0.0::DOUBLE) END AS duration_ms,
         CASE WHEN te IS NOT NULL THEN greatest(te - rs, 1.0::DOUBLE) END AS total_ms FROM sp JOIN f USING (root_id)"""


def otel_traces(s, d):
    """Events as an OpenTelemetry trace table: a trace per user, every fifth event a root."""
    e = table(s, d, "events")
    user = F.col("user_id").cast("string")
    return e.select(
        F.col("ts").alias("Timestamp"), user.alias("TraceId"), F.col("event_id").cast("string").alias("SpanId"),
        F.when(F.col("event_id") % 5 == 0, "").otherwise((F.col("event_id") - 1).cast("string")).alias("ParentSpanId"),
        F.col("event_type").alias("SpanName"), F.lit("SPAN_KIND_SERVER").alias("SpanKind"),
        (F.round("value") * 1_000_000).cast("bigint").alias("Duration"),
        F.when(F.col("event_type") == "error", "STATUS_CODE_ERROR").otherwise("STATUS_CODE_OK").alias("StatusCode"),
        F.when(F.col("event_type") == "error", "boom").otherwise("").alias("StatusMessage"),
        F.create_map(F.lit("k"), "event_type").alias("SpanAttributes"), F.create_map(F.lit("k"), F.lit("r"), F.lit("host"), user).alias("ResourceAttributes"),
    )


QUERIES["otel_spans"] = lambda s, d: otel_spans(otel_traces(s, d)).select(
    "id", "parent_id", "root_id", "name", "kind", "start_ms", "end_ms", "status", "error",
    F.element_at("attrs", "k").alias("k"), F.element_at("attrs", "host").alias("host"),
)
SQL["otel_spans"] = """
  SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id - 1 AS VARCHAR) END AS parent_id, CAST(user_id AS VARCHAR) AS root_id,
         event_type AS name, 'SPAN_KIND_SERVER' AS kind, CAST(epoch_us(ts) AS DOUBLE) / 1000 AS start_ms,
         CAST(epoch_us(ts) AS DOUBLE) / 1000 + round(value) AS end_ms,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CASE WHEN event_type = 'error' THEN 'boom' END AS error,
         event_type AS k, CAST(user_id AS VARCHAR) AS host FROM events"""

for name, source, sql in (("", spans, SPANS_SQL), ("_orders", order_spans, ORDER_SPANS_SQL)):
    QUERIES[f"tree_end{name}"] = lambda s, d, source=source: tree_end(source(s, d))
    SQL[f"tree_end{name}"] = f"""SELECT root_id, CASE WHEN count(*) = count(end_ms) THEN max(end_ms) END AS tree_end_ms,
      bool_or(status = 'running') AS has_running, count(*) AS n_rows FROM ({sql}) GROUP BY root_id"""
    QUERIES[f"waterfall{name}"] = lambda s, d, source=source: waterfall(source(s, d)).select(
        "id", "root_id", "kind", "duration_ms", "total_ms", "pct",
        F.round("offset_pct", 6).alias("offset_pct"), F.round("width_pct", 6).alias("width_pct"),
    )
    SQL[f"waterfall{name}"] = f"""
      WITH sp AS ({sql}), f AS (SELECT root_id, max(CASE WHEN parent_id IS NULL THEN start_ms END) AS rs,
             CASE WHEN count(*) = count(end_ms) THEN max(end_ms) END AS te FROM sp GROUP BY root_id),
      w AS (SELECT sp.id, sp.root_id, sp.kind, CASE WHEN end_ms IS NOT NULL THEN greatest(end_ms - start_ms, 0.0::DOUBLE) END AS duration_ms,
                   CASE WHEN te IS NOT NULL THEN greatest(te - rs, 1.0::DOUBLE) END AS total_ms, start_ms - rs AS lead
            FROM sp JOIN f USING (root_id)),
      p AS (SELECT *, duration_ms / total_ms * 100 AS share,
                   CASE WHEN total_ms IS NOT NULL THEN least(greatest(lead / total_ms * 100, 0), 100) END AS off FROM w)
      SELECT id, root_id, kind, duration_ms, total_ms, CAST(floor(share + 0.5) AS BIGINT) AS pct, round(off, 6) AS offset_pct,
             round(CASE WHEN share IS NOT NULL THEN least(greatest(share, 0), 100 - off) END, 6) AS width_pct FROM p"""
    QUERIES[f"phase_totals{name}"] = lambda s, d, source=source: phase_breakdown(source(s, d)).withColumn(
        "share_pct", F.round("share_pct", 6)
    )
    SQL[f"phase_totals{name}"] = f"""
      WITH t AS (SELECT root_id, kind, sum(end_ms - start_ms) AS total_ms FROM ({sql})
                 WHERE end_ms IS NOT NULL AND kind IN ('server', 'transport', 'decode', 'render', 'build') GROUP BY root_id, kind)
      SELECT root_id, kind, total_ms, round(total_ms / whole * 100, 6) AS share_pct
      FROM (SELECT *, sum(total_ms) OVER (PARTITION BY root_id) AS whole FROM t) WHERE whole > 0 AND total_ms > 0"""

QUERIES["action_summary"] = lambda s, d: action_summary(
    order_spans(s, d), F.col("kind").isin("server", "transport"), F.col("read_rows"), F.col("read_rows") * 8
)
SQL["action_summary"] = f"""
  SELECT root_id, CASE WHEN count(*) = count(end_ms) THEN greatest(max(end_ms) - max(CASE WHEN parent_id IS NULL THEN start_ms END), 0) END AS duration_ms,
         count(*) FILTER (WHERE q) AS n_queries, CAST(coalesce(sum(read_rows) FILTER (WHERE q), 0) AS BIGINT) AS read_rows,
         CAST(coalesce(sum(read_rows * 8) FILTER (WHERE q), 0) AS BIGINT) AS read_bytes,
         count(*) FILTER (WHERE q AND read_rows IS NOT NULL) > 0 AS has_server_stats
  FROM (SELECT *, kind IN ('server', 'transport') AS q FROM ({ORDER_SPANS_SQL})) GROUP BY root_id"""


def runs_sql(source: str) -> str:
    return f"""
      WITH r AS ({source}),
      f AS (SELECT *, CASE WHEN ok AND lag(ok) OVER w AND lag(name) OVER w = name THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY g ORDER BY o)),
      n AS (SELECT *, CAST(sum(new) OVER (PARTITION BY g ORDER BY o) AS BIGINT) AS run FROM f)
      SELECT g, run, min(name) AS name, count(*) AS n, min(o) AS first_o FROM n GROUP BY g, run"""


QUERIES["collapse_runs"] = lambda s, d: collapse_runs(
    spans(s, d).select((F.col("root_id") % 3).alias("g"), F.col("id").alias("o"), "kind", "status"),
    F.when(F.col("kind").isin("decode", "render"), "read").otherwise("write"), F.col("status") == "ok", ["g"], ["o"],
)
SQL["collapse_runs"] = runs_sql(
    f"SELECT root_id % 3 AS g, id AS o, CASE WHEN kind IN ('decode', 'render') THEN 'read' ELSE 'write' END AS name, status = 'ok' AS ok FROM ({SPANS_SQL})"
)
QUERIES["collapse_turns"] = lambda s, d: collapse_runs(
    table(s, d, "conversations").select(F.col("conv_id").alias("g"), F.col("turn").alias("o"), "role", "text"),
    F.col("role"), F.length("text") > 0, ["g"], ["o"],
)
SQL["collapse_turns"] = runs_sql("SELECT conv_id AS g, turn AS o, role AS name, length(text) > 0 AS ok FROM conversations")
