"""Reading, writing, keeping and dropping log tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.catalog.common import ATTR_EVENTS, ATTR_EVENTS_SQL, EVENTS, attr_events, table
from loglattice.operators import predicates as P
from loglattice.operators.predicates import filter_logs
from loglattice.operators.traces import logs_of_trace
from loglattice.operators.volume import volume
from loglattice.plans.durable import scratch_path
from loglattice.sources.logs import apply_retention, drop_expired, expired_partitions, read_logs, run_sql, write_logs
from loglattice.sources.otlp import otlp_logs, otlp_malformed, otlp_spans
from loglattice.sources.live import compact, expire_rows, read_live, sweep
from loglattice.sources.tokens import index_tokens, search_logs
from loglattice.view import LogView

QUERIES: dict = {}
SQL: dict[str, str] = {}
FROM, TO = "2024-01-10 18:00:00", "2024-01-11 07:00:00"
NOW = "2024-02-10 12:00:00"

QUERIES["src_table"] = lambda s, d: read_logs(s, f"{d}/events.parquet")
SQL["src_table"] = "SELECT * FROM events"

QUERIES["src_sql"] = lambda s, d: run_sql(
    s,
    "SELECT event_type, count(*) AS n FROM {events} WHERE ts >= $__fromTime AND ts <= $__toTime GROUP BY event_type",
    FROM, TO, events=table(s, d, "events"),
)
SQL["src_sql"] = f"SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{FROM}' AND ts <= TIMESTAMP '{TO}' GROUP BY event_type"


def written(s, d, by="day", bloom=()):
    path = scratch_path(s, "logs")
    view = write_logs(table(s, d, "events"), path, EVENTS, by, mode="overwrite", bloom=bloom)
    return read_logs(s, path), view


def _pruned(by):
    def run(s, d):
        df, view = written(s, d, by)
        return filter_logs(df, view, P.time_range(FROM, TO)).drop("event_date")

    return run


for by in ("day", "hour"):
    QUERIES[f"sink_partitioned_{by}"] = _pruned(by)
    SQL[f"sink_partitioned_{by}"] = f"SELECT * FROM events WHERE ts >= TIMESTAMP '{FROM}' AND ts <= TIMESTAMP '{TO}'"


def _bloom(s, d):
    df, view = written(s, d, bloom=("user_id",))
    return logs_of_trace(df, view.with_(trace_id="user_id"), "42").drop("event_date")


QUERIES["sink_bloom"] = _bloom
SQL["sink_bloom"] = "SELECT * FROM events WHERE user_id = 42"


def _retained(s, d):
    df, view = written(s, d)
    return apply_retention(df, view, NOW).drop("event_date")


QUERIES["sink_retention"] = _retained
SQL["sink_retention"] = f"SELECT * FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY"


def _dropped(s, d):
    """What is left of a table once its expired partitions are gone."""
    path = scratch_path(s, "logs")
    view = write_logs(table(s, d, "events"), path, EVENTS, mode="overwrite")
    drop_expired(s, path, view, NOW)
    return read_logs(s, path).drop("event_date")


QUERIES["sink_retention_drop"] = _dropped
SQL["sink_retention_drop"] = f"SELECT * FROM events WHERE CAST(ts AS DATE) >= CAST(TIMESTAMP '{NOW}' - INTERVAL 30 DAY AS DATE)"


def _expired(s, d):
    df, view = written(s, d)
    return expired_partitions(df, view, NOW)


QUERIES["sink_expired"] = _expired
SQL["sink_expired"] = f"SELECT DISTINCT CAST(ts AS DATE) AS event_date FROM events WHERE CAST(ts AS DATE) < CAST(TIMESTAMP '{NOW}' - INTERVAL 30 DAY AS DATE)"


def _retained_rows(s, d):
    """What is left of a table once its expired rows are gone, those of the day of the bound too."""
    path = scratch_path(s, "logs")
    view = write_logs(table(s, d, "events"), path, EVENTS, mode="overwrite")
    expire_rows(s, path, view, NOW)
    sweep(s, path)
    return read_live(s, path).drop("event_date")


QUERIES["sink_retention_rows"] = _retained_rows
SQL["sink_retention_rows"] = f"SELECT * FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY"


def _searched(*searches, indexed=True):
    """Messages written in two appends with filters of their words, then searched."""

    def run(s, d):
        path = scratch_path(s, "logs")
        rows = attr_events(s, d)
        noon = F.col("ts") < F.lit("2024-01-16 12:00:00").cast("timestamp_ntz")
        view = write_logs(rows.filter(noon), path, ATTR_EVENTS, mode="overwrite", tokens=True)
        write_logs(rows.filter(~noon), path, ATTR_EVENTS, tokens=indexed)
        return search_logs(s, path, view, *searches).select("event_id", "message")

    return run


PHRASE_SQL = f"SELECT event_id, message FROM ({ATTR_EVENTS_SQL}) WHERE regexp_matches(message, '(^|[^a-zA-Z0-9_])req-7($|[^a-zA-Z0-9_])', 'i')"
QUERIES["sink_tokens_phrase"] = _searched(P.phrase("req-7"))
SQL["sink_tokens_phrase"] = PHRASE_SQL
QUERIES["sink_tokens_unindexed"] = _searched(P.phrase("req-7"), indexed=False)
SQL["sink_tokens_unindexed"] = PHRASE_SQL
QUERIES["sink_tokens_term"] = _searched((P.term("Q-9") & ~P.phrase("click")) | P.wildcard("error: req-1* took_3%"), P.gt("value", 20))
SQL["sink_tokens_term"] = f"""SELECT event_id, message FROM ({ATTR_EVENTS_SQL})
  WHERE ((message ILIKE '%Q-9%' AND NOT regexp_matches(message, '(^|[^a-zA-Z0-9_])click($|[^a-zA-Z0-9_])', 'i'))
         OR regexp_full_match(message, 'error: req-1.* took_3%')) AND value > 20"""


# --- collector payloads: a request for every hundred events, with one resource and two scopes ---

def _attribute(key: str, kind: str, value: Column) -> Column:
    """{"key": …, "value": {kind: …}} as JSON."""
    return F.to_json(F.struct(F.lit(key).alias("key"), F.struct(value.alias(kind)).alias("value")))


def _nanos(extra: int = 0) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.concat((F.timestamp_diff("MICROSECOND", epoch, F.col("ts")) + extra).cast("string"), F.lit("000"))


def payloads(s, d, kind: str = "Logs") -> DataFrame:
    i = F.col("event_id")
    listed = F.concat(
        F.lit('{"key":"pair","value":{"arrayValue":{"values":[{"intValue":"'), i.cast("string"), F.lit('"},{"boolValue":'), (i % 2 == 0).cast("string"),
        F.lit("}]}}}"),
    )
    attributes = F.concat(
        F.lit("["), F.concat_ws(",", _attribute("user", "intValue", F.col("user_id").cast("string")), _attribute("type", "stringValue", F.col("event_type")), listed), F.lit("]")
    )
    fields = F.struct(
        _nanos().alias("timeUnixNano"), F.col("event_type").alias("severityText"), (i % 24).alias("severityNumber"), F.hex(i).alias("traceId"),
        F.hex(i * 16).alias("spanId"),
    ) if kind == "Logs" else F.struct(
        _nanos().alias("startTimeUnixNano"), _nanos(1500).alias("endTimeUnixNano"), F.hex(i - i % 4).alias("traceId"), F.hex(i).alias("spanId"),
        F.when(i % 4 > 0, F.hex(i - i % 4)).alias("parentSpanId"), F.col("event_type").alias("name"), (i % 6).alias("kind"),
        F.struct((i % 3).alias("code")).alias("status"),
    )
    body = F.concat(F.lit(',"body":'), F.to_json(F.struct(F.concat(F.lit('said "'), F.col("event_type"), F.lit('"')).alias("stringValue")))) if kind == "Logs" else F.lit("")
    record = F.concat(F.expr("substr(j, 1, length(j) - 1)"), body, F.lit(',"attributes":'), attributes, F.lit("}"))
    rows = table(s, d, "events").withColumn("j", F.to_json(fields)).select((i / 100).cast("bigint").alias("g"), (i % 2).alias("scope"), i, record.alias("r"))
    items = {"Logs": "logRecords", "Spans": "spans"}[kind]
    # a hundred records a request
    scopes = rows.groupBy("g", "scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "r"))), lambda x: x["r"]), ",").alias("rs"))
    scope = F.concat(F.lit('{"scope":{"name":"s'), F.col("scope").cast("string"), F.lit(f'"}},"{items}":['), F.col("rs"), F.lit("]}"))
    request = scopes.groupBy("g").agg(F.array_join(F.array_sort(F.collect_list(scope)), ",").alias("ss"))
    service = F.concat(F.lit('{"key":"service.name","value":{"stringValue":"svc-'), (F.col("g") % 5).cast("string"), F.lit('"}}'))
    head = F.concat(F.lit(f'{{"resource{kind}":[{{"resource":{{"attributes":['), service, F.lit(f']}},"scope{kind}":['))
    return request.select(F.concat(head, F.col("ss"), F.lit("]}]}")).alias("value"))


def _flat(logs: DataFrame) -> DataFrame:
    return logs.select(
        F.col("Timestamp").cast("timestamp_ntz").alias("ts"), "TraceId", "SpanId", "SeverityText", "SeverityNumber", "ServiceName", "Body", "ScopeName",
        F.col("LogAttributes")["user"].alias("user"), F.col("LogAttributes")["pair"].alias("pair"),
    )


QUERIES["src_otlp_logs"] = lambda s, d: _flat(otlp_logs(payloads(s, d)))
SQL["src_otlp_logs"] = """
  SELECT ts, to_hex(event_id) AS "TraceId", to_hex(event_id * 16) AS "SpanId", event_type AS "SeverityText", CAST(event_id % 24 AS INTEGER) AS "SeverityNumber",
         'svc-' || (event_id // 100 % 5) AS "ServiceName", 'said "' || event_type || '"' AS "Body", 's' || (event_id % 2) AS "ScopeName",
         CAST(user_id AS VARCHAR) AS user, '[' || event_id || ',' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ']' AS pair FROM events"""

QUERIES["src_otlp_spans"] = lambda s, d: otlp_spans(payloads(s, d, "Spans")).select(
    F.col("Timestamp").cast("timestamp_ntz").alias("ts"), "TraceId", "SpanId", "ParentSpanId", "SpanName", "SpanKind", "ServiceName", "Duration", "StatusCode",
    F.col("SpanAttributes")["type"].alias("type"), F.size("Events").alias("n_events"),
)
SQL["src_otlp_spans"] = """
  SELECT ts, to_hex(event_id - event_id % 4) AS "TraceId", to_hex(event_id) AS "SpanId", CASE WHEN event_id % 4 > 0 THEN to_hex(event_id - event_id % 4) ELSE '' END AS "ParentSpanId",
         event_type AS "SpanName", ['Unspecified', 'Internal', 'Server', 'Client', 'Producer', 'Consumer'][event_id % 6 + 1] AS "SpanKind",
         'svc-' || (event_id // 100 % 5) AS "ServiceName", CAST(1500000 AS BIGINT) AS "Duration", ['Unset', 'Ok', 'Error'][event_id % 3 + 1] AS "StatusCode",
         event_type AS type, 0 AS n_events FROM events"""
