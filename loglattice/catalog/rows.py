"""Projections, lists, pages, single rows and rows around an instant."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from loglattice.catalog.common import ATTR_EVENTS, ATTR_EVENTS_SQL, DOCS, EVENTS, TURNS, attr_events, table
from loglattice.operators.near import first_rows, surrounding_few
from loglattice.operators import predicates as P
from loglattice.operators.compare import compare_rows, diff_within
from loglattice.operators.explore import (
    detail, duplicate_groups, explore, extract, full, grid, hydrate, page, page_after, surrounding, surrounding_many, with_row_key,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}
TS = "2024-01-16 12:00:00"


def events(s, d):
    return table(s, d, "events")


QUERIES["proj_grid"] = lambda s, d: grid(attr_events(s, d), ATTR_EVENTS, ["attrs.http.method", "value"]).withColumnRenamed("attrs.http.method", "method")
SQL["proj_grid"] = f"""SELECT ts AS __timestamp, message AS __body, event_type AS __severity, service AS "__serviceName",
  coalesce(attrs['http.method'], '') AS method, value FROM ({ATTR_EVENTS_SQL})"""

QUERIES["proj_full"] = lambda s, d: full(events(s, d), EVENTS, [("k", F.get_json_object("props", "$.k"))])
SQL["proj_full"] = "SELECT *, json_extract_string(props, '$.k') AS k FROM events"

QUERIES["extract"] = lambda s, d: extract(
    attr_events(s, d), ATTR_EVENTS, {"bucket": "attrs.bucket", "k": "props.k", "gone": "props.a.b"}
).select("event_id", "bucket", "k", "gone")
SQL["extract"] = f"""SELECT event_id, coalesce(attrs['bucket'], '') AS bucket, json_extract_string(props, '$.k') AS k,
  json_extract_string(props, '$.a.b') AS gone FROM ({ATTR_EVENTS_SQL})"""

# the key itself is an engine detail; that equal content (and only that) shares a key is not
QUERIES["row_key"] = lambda s, d: (
    with_row_key(table(s, d, "documents"), DOCS).groupBy("row_key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
    .select("first_doc", "n")
)
SQL["row_key"] = "SELECT min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY text, lang, source"

QUERIES["list_recent"] = lambda s, d: explore(events(s, d), EVENTS, P.eq("event_type", "error"))
SQL["list_recent"] = "SELECT * FROM events WHERE event_type = 'error' ORDER BY ts DESC NULLS LAST, event_id LIMIT 200"
QUERIES["list_sorted"] = lambda s, d: explore(events(s, d), EVENTS, None, sort="__severity", descending=False, limit=150, projection="grid")
SQL["list_sorted"] = """SELECT ts AS __timestamp, event_type AS __severity, user_id AS "__serviceName" FROM events
  ORDER BY event_type ASC NULLS LAST, event_id LIMIT 150"""
QUERIES["list_docs"] = lambda s, d: explore(table(s, d, "documents"), DOCS, P.term("the"), sort="n_chars", limit=50).select("doc_id", "n_chars")
SQL["list_docs"] = "SELECT doc_id, n_chars FROM documents WHERE text ILIKE '%the%' ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 50"

QUERIES["page"] = lambda s, d: page(events(s, d), EVENTS, 3, 50)
SQL["page"] = "SELECT * FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 50 OFFSET 150"
QUERIES["page_after"] = lambda s, d: page_after(events(s, d), EVENTS, {"ts": TS, "event_id": 0}, 50)
SQL["page_after"] = f"""SELECT * FROM events WHERE ts < TIMESTAMP '{TS}' OR (ts = TIMESTAMP '{TS}' AND event_id > 0)
  ORDER BY ts DESC, event_id LIMIT 50"""



def _detail(s, d):
    """The full row behind the first row of a list of errors."""
    listed = explore(events(s, d), EVENTS, P.eq("event_type", "error"), descending=False, limit=1, projection="grid").first()
    return detail(events(s, d), EVENTS, {k: listed[k] for k in ("__timestamp", "__severity")})


QUERIES["detail"] = _detail
SQL["detail"] = """WITH r AS (SELECT date_trunc('millisecond', min(ts)) AS ms FROM events WHERE event_type = 'error')
  SELECT e.* FROM events e, r WHERE e.ts >= ms AND e.ts < ms + INTERVAL 1 MILLISECOND AND event_type = 'error' ORDER BY event_id LIMIT 1"""

QUERIES["hydrate_many"] = lambda s, d: hydrate(
    events(s, d), explore(events(s, d), EVENTS, P.eq("event_type", "click"), projection="grid"), EVENTS
).drop("__timestamp", "__severity", "__serviceName")
SQL["hydrate_many"] = "SELECT * FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 200"
QUERIES["hydrate_docs"] = lambda s, d: hydrate(
    table(s, d, "documents"), grid(table(s, d, "documents"), DOCS).select("__body", "__severity", "__serviceName"), DOCS
).groupBy("doc_id").agg(F.count("*").alias("n"))
SQL["hydrate_docs"] = "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text, lang, source"

QUERIES["dup_rows"] = lambda s, d: duplicate_groups(
    events(s, d).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")), EVENTS
).select("n_rows", "first_seen", "last_seen")
SQL["dup_rows"] = """SELECT count(*) AS n_rows, min(h) AS first_seen, max(h) AS last_seen
  FROM (SELECT *, date_trunc('hour', ts) AS h FROM events) GROUP BY h, event_type, user_id HAVING count(*) > 1"""
QUERIES["dup_docs"] = lambda s, d: duplicate_groups(table(s, d, "documents"), DOCS).select("n_rows")
SQL["dup_docs"] = "SELECT count(*) AS n_rows FROM documents GROUP BY text, lang, source HAVING count(*) > 1"

for name, op, order in (("before", "<", "DESC"), ("after", ">", "ASC")):
    QUERIES[f"surrounding_{name}"] = lambda s, d, name=name: surrounding(events(s, d), EVENTS, TS, 25, name)
    SQL[f"surrounding_{name}"] = f"""SELECT ts AS timestamp, '' AS body, event_type AS severity, user_id AS "serviceName", event_id
      FROM events WHERE ts {op} TIMESTAMP '{TS}' ORDER BY ts {order}, event_id LIMIT 25"""


def _surrounding_many(s, d):
    anchors = events(s, d).filter(F.col("event_type") == "error").select(F.col("event_id").alias("anchor_id"), "user_id", "ts")
    return surrounding_many(events(s, d), EVENTS, anchors, n=3)


QUERIES["surrounding_many"] = _surrounding_many
SQL["surrounding_many"] = """
  WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
  a AS (SELECT event_id AS anchor_id, user_id, ts FROM events WHERE event_type = 'error'),
  pos AS (SELECT a.anchor_id, a.user_id,
                 count(*) FILTER (WHERE e.ts < a.ts) AS nb, count(*) FILTER (WHERE e.ts <= a.ts) AS nle
          FROM a JOIN e ON a.user_id = e.user_id GROUP BY a.anchor_id, a.user_id)
  SELECT pos.anchor_id, CAST(CASE WHEN e.p <= nb THEN e.p - nb - 1 ELSE e.p - nle END AS INTEGER) AS "offset", e.user_id, e.ts, e.event_id
  FROM pos JOIN e ON e.user_id = pos.user_id AND (e.p BETWEEN nb - 2 AND nb OR e.p BETWEEN nle + 1 AND nle + 3)
"""

def _surrounding_few(s, d):
    """Around the largest value of each day."""
    top = F.max(F.struct("value", "event_id", "user_id", "ts")).alias("m")
    anchors = events(s, d).groupBy(F.to_date("ts")).agg(top).select(F.col("m.event_id").alias("anchor_id"), "m.user_id", "m.ts")
    return surrounding_few(events(s, d), EVENTS, anchors, n=3)


QUERIES["surrounding_few"] = _surrounding_few
SQL["surrounding_few"] = SQL["surrounding_many"].replace(
    "FROM events WHERE event_type = 'error'", "FROM events QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value DESC, event_id DESC) = 1"
)

QUERIES["first_by_value"] = lambda s, d: first_rows(events(s, d), EVENTS, 200, "value", sample_rows=2000)
SQL["first_by_value"] = "SELECT * FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 200"
QUERIES["page_by_type"] = lambda s, d: first_rows(
    events(s, d), EVENTS, 50, "event_type", descending=False, offset=500, where=P.gt("props.k", 5), sample_rows=300
)
SQL["page_by_type"] = """SELECT * FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 5
  ORDER BY event_type NULLS LAST, event_id LIMIT 50 OFFSET 500"""

QUERIES["compare"] = lambda s, d: compare_rows(events(s, d), EVENTS, F.col("event_id") == 5)
SQL["compare"] = """
  WITH t AS (SELECT event_id, CAST(ts AS VARCHAR) AS ts, event_type, props, CAST(user_id AS VARCHAR) AS user_id, CAST(value AS VARCHAR) AS val FROM events),
  l AS (UNPIVOT t ON ts, event_type, props, user_id, val INTO NAME field VALUE value)
  SELECT l.event_id, CASE l.field WHEN 'val' THEN 'value' ELSE l.field END AS field,
         CAST(list_position(['ts', 'event_type', 'props', 'user_id', 'value'], CASE l.field WHEN 'val' THEN 'value' ELSE l.field END) AS INTEGER) AS field_order,
         l.value, l.value IS NOT DISTINCT FROM r.value AS same
  FROM l JOIN (SELECT field, value FROM l WHERE event_id = 5) r ON l.field = r.field
"""
QUERIES["compare_groups"] = lambda s, d: diff_within(table(s, d, "conversations"), TURNS, "conv_id")
SQL["compare_groups"] = """
  WITH t AS (SELECT conv_id, CAST(turn AS VARCHAR) AS turn, role, text FROM conversations),
  l AS (UNPIVOT t ON turn, role, text INTO NAME field VALUE value)
  SELECT conv_id, field, count(DISTINCT value) AS n_values, count(*) AS n_rows, count(DISTINCT value) > 1 AS differs
  FROM l GROUP BY conv_id, field
"""

# the same list, timestamps first, as on inputs of very many tasks
QUERIES["list_recent_time_first"] = lambda s, d: explore(events(s, d), EVENTS, P.eq("event_type", "error"), time_first=True)
SQL["list_recent_time_first"] = SQL["list_recent"]
