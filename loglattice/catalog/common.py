"""The given tables seen as logs, spans and a query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.sources.logs import read_logs
from loglattice.view import LogView

EVENTS = LogView(
    timestamp="ts", severity="event_type", service="user_id", row_id=("event_id",), json_columns=("props",)
)
DOCS = LogView(body="text", severity="lang", service="source", row_id=("doc_id",))
LINES = LogView(timestamp="l_shipdate", severity="l_returnflag", service="l_linestatus")
ORDERS = LogView(timestamp="o_orderdate", severity="o_orderpriority", service="o_orderstatus", row_id=("o_orderkey",))
TURNS = LogView(body="text", severity="role", trace_id="conv_id", row_id=("conv_id", "turn"))
# events with a derived attribute map and a message built from three columns
ATTR_EVENTS = LogView(
    timestamp="ts", body="message", severity="event_type", service="service", row_id=("event_id",), json_columns=("props",)
)

ATTR_EVENTS_SQL = """
  SELECT event_id, ts, event_type, CAST(user_id AS VARCHAR) AS service, value, props,
         event_type || ': req-' || CAST(user_id AS VARCHAR) || ' took_' || CAST(event_id % 10 AS VARCHAR) || '%' AS message,
         CASE WHEN event_id % 3 = 0
              THEN MAP {'http.method': event_type, 'latency': CAST(event_id % 2000 AS VARCHAR)}
              WHEN event_id % 3 = 1
              THEN MAP {'http.method': event_type, 'http.url': '/u/' || CAST(user_id AS VARCHAR), 'latency': 'n/a'}
              ELSE MAP {'bucket': CAST(user_id % 7 AS VARCHAR)} END AS attrs
  FROM events
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_logs(spark, f"{sf}/{name}.parquet")


def attr_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    user = F.col("user_id").cast("string")
    third = F.col("event_id") % 3
    return e.select(
        "event_id",
        "ts",
        "event_type",
        user.alias("service"),
        "value",
        "props",
        F.concat("event_type", F.lit(": req-"), user, F.lit(" took_"), (F.col("event_id") % 10).cast("string"), F.lit("%")).alias("message"),
        F.when(
            third == 0,
            F.create_map(F.lit("http.method"), "event_type", F.lit("latency"), (F.col("event_id") % 2000).cast("string")),
        )
        .when(
            third == 1,
            F.create_map(
                F.lit("http.method"), "event_type", F.lit("http.url"), F.concat(F.lit("/u/"), user), F.lit("latency"), F.lit("n/a")
            ),
        )
        .otherwise(F.create_map(F.lit("bucket"), (F.col("user_id") % 7).cast("string")))
        .alias("attrs"),
    )


# --- spans: every 64 consecutive events form one binary tree ------------------------------------

SPANS_SQL = """
  SELECT event_id AS id,
         event_id - event_id % 64 AS root_id,
         CASE WHEN event_id % 64 = 0 THEN NULL
              ELSE event_id - event_id % 64 + (event_id % 64 - 1) // 2 END AS parent_id,
         event_type || '-op' AS name,
         CASE event_type WHEN 'click' THEN 'decode' WHEN 'view' THEN 'render' WHEN 'purchase' THEN 'server'
                         WHEN 'signup' THEN 'transport' ELSE 'build' END AS kind,
         CAST(epoch_us(ts) // 1000 AS DOUBLE) AS start_ms,
         CASE WHEN event_id % 640 = 37 THEN NULL
              ELSE CAST(epoch_us(ts) // 1000 AS DOUBLE) + round(value * 1000) END AS end_ms,
         CASE WHEN event_id % 640 = 37 THEN 'running' WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'error'
              ELSE 'ok' END AS status
  FROM events
"""


def spans(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    i = F.col("event_id")
    local = i % 64
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    ms = F.floor(us / 1000).cast("double")
    running = i % 640 == 37
    kind = (
        F.when(F.col("event_type") == "click", "decode")
        .when(F.col("event_type") == "view", "render")
        .when(F.col("event_type") == "purchase", "server")
        .when(F.col("event_type") == "signup", "transport")
        .otherwise("build")
    )
    return e.select(
        i.alias("id"),
        (i - local).alias("root_id"),
        F.when(local != 0, i - local + F.floor((local - 1) / 2)).alias("parent_id"),
        F.concat("event_type", F.lit("-op")).alias("name"),
        kind.alias("kind"),
        ms.alias("start_ms"),
        F.when(~running, ms + F.round(F.col("value") * 1000)).alias("end_ms"),
        F.when(running, "running")
        .when((F.col("event_type") == "error") & (i % 4 == 0), "error")
        .otherwise("ok")
        .alias("status"),
    )


# --- spans: an order is a root, its lines are children ------------------------------------------

ORDER_SPANS_SQL = """
  SELECT o_orderkey AS root_id, NULL AS parent_id, o_orderkey * 10 AS id, 'action' AS kind,
         CAST(o_orderkey * 1000 AS DOUBLE) AS start_ms, CAST(o_orderkey * 1000 + 50 AS DOUBLE) AS end_ms,
         CASE WHEN o_orderstatus = 'P' THEN 'running' ELSE 'ok' END AS status, CAST(NULL AS BIGINT) AS read_rows
  FROM orders
  UNION ALL
  SELECT l_orderkey, l_orderkey * 10, l_orderkey * 10 + l_linenumber,
         CASE l_returnflag WHEN 'A' THEN 'decode' WHEN 'N' THEN 'server' ELSE 'transport' END,
         CAST(l_orderkey * 1000 + l_linenumber * 7 AS DOUBLE),
         CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 AND l_orderkey % 5 = 0 THEN NULL
              ELSE CAST(l_orderkey * 1000 + l_linenumber * 7 AS DOUBLE) + l_quantity END,
         'ok', l_partkey
  FROM lineitem
"""


def order_spans(spark: SparkSession, sf: str) -> DataFrame:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    key = F.col("o_orderkey")
    roots = o.select(
        key.alias("root_id"),
        F.lit(None).cast("bigint").alias("parent_id"),
        (key * 10).alias("id"),
        F.lit("action").alias("kind"),
        (key * 1000).cast("double").alias("start_ms"),
        (key * 1000 + 50).cast("double").alias("end_ms"),
        F.when(F.col("o_orderstatus") == "P", "running").otherwise("ok").alias("status"),
        F.lit(None).cast("bigint").alias("read_rows"),
    )
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    start = (k * 1000 + n * 7).cast("double")
    open_ = (F.col("l_linestatus") == "O") & (n == 7) & (k % 5 == 0)
    lines = li.select(
        k.alias("root_id"),
        (k * 10).alias("parent_id"),
        (k * 10 + n).alias("id"),
        F.when(F.col("l_returnflag") == "A", "decode").when(F.col("l_returnflag") == "N", "server").otherwise("transport").alias("kind"),
        start.alias("start_ms"),
        F.when(~open_, start + F.col("l_quantity")).alias("end_ms"),
        F.lit("ok").alias("status"),
        F.col("l_partkey").alias("read_rows"),
    )
    return roots.unionByName(lines)


# --- a query log: one tagged row for each event, two for every seventh -----------------

PREFIX = "app"
QLOG_SQL = """
  SELECT event_id * 10 + n AS query_id, ts + n * INTERVAL 1 SECOND AS event_time,
         'app|' || CAST(event_id - event_id % 64 AS VARCHAR) || '|' || CAST(event_id AS VARCHAR) || '|' || event_type AS log_comment,
         CASE event_type WHEN 'error' THEN 'ExceptionWhileProcessing' WHEN 'signup' THEN 'QueryStart' ELSE 'QueryFinish' END AS type,
         CAST(round(value * 100) AS BIGINT) + n AS query_duration_ms,
         user_id * 1000 AS read_rows, event_id % 50 AS result_rows,
         CASE WHEN event_type = 'error' THEN 241 ELSE 0 END AS exception_code,
         event_type AS op,
         'SELECT * FROM shop.' || event_type || ' WHERE body = ''it ' || CASE WHEN event_id % 5 = 1 THEN 'LIMIT 3' ELSE 'sample' END
           || ''' AND mode = ''break'' /* user ' || CAST(user_id AS VARCHAR) || ' */'
           || CASE WHEN event_id % 2 = 0 THEN ' LIMIT ' || CAST(event_id % 40 AS VARCHAR) ELSE '' END
           || CASE WHEN event_id % 3 = 0 THEN ' SETTINGS read_overflow_mode = ''break''' ELSE '' END
           || CASE WHEN event_id % 11 = 0 THEN ', group_by_overflow_mode = ''any''' ELSE '' END
           || CASE WHEN event_id % 13 = 0 THEN ' -- sample' ELSE '' END
           || CASE WHEN event_id % 17 = 0 THEN ' SAMPLE 0.1' ELSE '' END AS query,
         'SELECT * FROM shop.' || event_type || ' WHERE body = ''<redacted>'' AND mode = ''break''  '
           || CASE WHEN event_id % 2 = 0 THEN ' LIMIT ' || CAST(event_id % 40 AS VARCHAR) ELSE '' END
           || CASE WHEN event_id % 3 = 0 THEN ' SETTINGS read_overflow_mode = ''break''' ELSE '' END
           || CASE WHEN event_id % 11 = 0 THEN ', group_by_overflow_mode = ''any''' ELSE '' END
           || CASE WHEN event_id % 13 = 0 THEN '  ' WHEN event_id % 17 = 0 THEN ' SAMPLE 0.1' ELSE '' END AS clean
  FROM events CROSS JOIN (VALUES (1), (2)) AS c(n)
  WHERE n = 1 OR event_id % 7 = 0
"""


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    i = F.col("event_id")
    copies = F.when(i % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    e = e.withColumn("n", F.explode(copies))
    text = lambda c: c.cast("string")

    def when(cond, then):
        return F.when(cond, then).otherwise(F.lit(""))

    return e.select(
        (i * 10 + F.col("n")).alias("query_id"),
        (F.col("ts") + F.make_dt_interval(secs=F.col("n"))).alias("event_time"),
        F.concat_ws("|", F.lit(PREFIX), text(i - i % 64), text(i), "event_type").alias("log_comment"),
        F.when(F.col("event_type") == "error", "ExceptionWhileProcessing")
        .when(F.col("event_type") == "signup", "QueryStart")
        .otherwise("QueryFinish")
        .alias("type"),
        (F.round(F.col("value") * 100).cast("bigint") + F.col("n")).alias("query_duration_ms"),
        (F.col("user_id") * 1000).alias("read_rows"),
        (i % 50).alias("result_rows"),
        F.when(F.col("event_type") == "error", 241).otherwise(0).alias("exception_code"),
        F.col("event_type").alias("op"),
        F.concat(
            F.lit("SELECT * FROM shop."),
            "event_type",
            F.lit(" WHERE body = 'it "),
            F.when(i % 5 == 1, "LIMIT 3").otherwise("sample"),
            F.lit("' AND mode = 'break' /* user "),
            text(F.col("user_id")),
            F.lit(" */"),
            when(i % 2 == 0, F.concat(F.lit(" LIMIT "), text(i % 40))),
            when(i % 3 == 0, F.lit(" SETTINGS read_overflow_mode = 'break'")),
            when(i % 11 == 0, F.lit(", group_by_overflow_mode = 'any'")),
            when(i % 13 == 0, F.lit(" -- sample")),
            when(i % 17 == 0, F.lit(" SAMPLE 0.1")),
        ).alias("query"),
    )
