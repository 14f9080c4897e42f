"""Attribute columns: text to typed, containers to rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.catalog.common import ATTR_EVENTS, ATTR_EVENTS_SQL, attr_events, table
from loglattice.catalog.profiles import NESTED_SQL, nested
from loglattice.operators.flatten import flatten_json, flatten_map, flatten_rows, normalize_attrs, normalize_report
from loglattice.operators.profile import json_paths
from loglattice.view import LogView

QUERIES: dict = {}
SQL: dict[str, str] = {}
NESTED = LogView(row_id=("event_id",), json_columns=("payload",))

# attribute text as servers print it: double quotes, single quotes, nested values, and rubbish
TEXT_SQL = """SELECT event_id, CASE event_id % 5
    WHEN 0 THEN '{"type":"' || event_type || '","n":' || user_id || '}'
    WHEN 1 THEN '{''type'':''' || event_type || '''}'
    WHEN 2 THEN '{"type":"' || event_type || '","more":' || props || '}'
    WHEN 3 THEN 'not a map' ELSE '[1,2]' END AS attrs, user_id, event_type, props FROM events"""


def text_attrs(s, d):
    e = table(s, d, "events")
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    fifth = F.col("event_id") % 5
    text = (
        F.when(fifth == 0, F.concat(F.lit('{"type":"'), kind, F.lit('","n":'), user, F.lit("}")))
        .when(fifth == 1, F.concat(F.lit("{'type':'"), kind, F.lit("'}")))
        .when(fifth == 2, F.concat(F.lit('{"type":"'), kind, F.lit('","more":'), "props", F.lit("}")))
        .when(fifth == 3, "not a map")
        .otherwise("[1,2]")
    )
    return e.select("event_id", text.alias("attrs"), "user_id", "event_type", "props")


QUERIES["normalize_attrs"] = lambda s, d: normalize_attrs(text_attrs(s, d), maps=["attrs"], bad_flags=True).select(
    "event_id",
    F.coalesce(F.element_at("attrs", "type"), F.lit("")).alias("type"),
    F.coalesce(F.element_at("attrs", "n"), F.lit("")).alias("n"),
    F.replace(F.coalesce(F.element_at("attrs", "more"), F.lit("")), F.lit(" "), F.lit("")).alias("more"),
    F.size("attrs").alias("n_keys"),
    F.col("attrs_bad").alias("bad"),
)
SQL["normalize_attrs"] = f"""SELECT event_id, CASE WHEN event_id % 5 < 3 THEN event_type ELSE '' END AS type,
  CASE WHEN event_id % 5 = 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS n,
  CASE WHEN event_id % 5 = 2 THEN replace(props, ' ', '') ELSE '' END AS more,
  CAST([2, 1, 2, 0, 0][event_id % 5 + 1] AS INTEGER) AS n_keys, event_id % 5 >= 3 AS bad FROM ({TEXT_SQL})"""
QUERIES["normalize_report"] = lambda s, d: normalize_report(text_attrs(s, d), maps=["attrs"], jsons=["props"])
SQL["normalize_report"] = f"""SELECT 'attrs' AS "column", count(*) AS n_rows, count(*) AS n_present, count(*) FILTER (WHERE event_id % 5 >= 3) AS n_bad FROM ({TEXT_SQL})
  UNION ALL SELECT 'props', count(*), count(*), 0 FROM ({TEXT_SQL})"""

QUERIES["flatten_map"] = lambda s, d: flatten_map(attr_events(s, d), ATTR_EVENTS)
SQL["flatten_map"] = f"""SELECT event_id, 'attrs' AS "column", e.key AS key, e.value AS value
  FROM (SELECT event_id, unnest(map_entries(attrs)) AS e FROM ({ATTR_EVENTS_SQL}))"""

LEAVES_SQL = f"""
  SELECT event_id, 'user.id' AS key, json_extract_string(payload, '$.user.id') AS value FROM ({NESTED_SQL})
  UNION ALL SELECT event_id, 'user.name', json_extract_string(payload, '$.user.name') FROM ({NESTED_SQL})
  UNION ALL SELECT event_id, 'props.k', json_extract_string(payload, '$.props.k') FROM ({NESTED_SQL})
  UNION ALL SELECT event_id, 'tags', '["a",{{"b":1}}]' FROM ({NESTED_SQL}) WHERE event_id % 3 = 0
  UNION ALL SELECT event_id, 'gone', '' FROM ({NESTED_SQL}) WHERE event_id % 3 = 0
  UNION ALL SELECT event_id, 'deep.x.y.z', 'true' FROM ({NESTED_SQL}) WHERE event_id % 10 = 0"""
QUERIES["flatten_json"] = lambda s, d: flatten_json(nested(s, d), NESTED, "payload")
SQL["flatten_json"] = LEAVES_SQL

# objects fifteen deep, of which some rows have fewer
DEEP = [f"n{i}" for i in range(15)]


def deep(s, d):
    e = table(s, d, "events")
    user = F.col("user_id").cast("string")
    levels = (F.col("event_id") % 15 + 1).cast("int")
    head = F.array_join(F.slice(F.array(*[F.lit(f'{{"{n}":') for n in DEEP]), F.lit(1), levels), "")
    return e.select("event_id", F.concat(head, user, F.repeat(F.lit("}"), levels)).alias("payload"))


DEEP_SQL = "SELECT event_id, array_to_string([" + ", ".join(f"'{n}'" for n in DEEP) + "][1:event_id % 15 + 1], '.') AS key, CAST(user_id AS VARCHAR) AS value FROM events"
QUERIES["flatten_json_deep"] = lambda s, d: flatten_json(deep(s, d), NESTED, "payload")
SQL["flatten_json_deep"] = DEEP_SQL
QUERIES["json_paths_deep"] = lambda s, d: json_paths(deep(s, d), "payload").select("path", "count")
SQL["json_paths_deep"] = f"SELECT key AS path, count(*) AS count FROM ({DEEP_SQL}) GROUP BY key"

QUERIES["flatten_span_attributes"] = lambda s, d: flatten_rows(
    text_attrs(s, d).select("event_id", "attrs"), LogView(row_id=("event_id",), span_attributes="attrs")
).filter("key <> 'event_id'").withColumn("value", F.replace("value", F.lit(" "), F.lit("")))
SQL["flatten_span_attributes"] = f"""
  SELECT event_id, 'attrs.type' AS key, event_type AS value, 'string' AS type FROM ({TEXT_SQL}) WHERE event_id % 5 < 3
  UNION ALL SELECT event_id, 'attrs.n', CAST(user_id AS VARCHAR), 'string' FROM ({TEXT_SQL}) WHERE event_id % 5 = 0
  UNION ALL SELECT event_id, 'attrs.more', replace(props, ' ', ''), 'string' FROM ({TEXT_SQL}) WHERE event_id % 5 = 2"""

QUERIES["flatten_row"] = lambda s, d: flatten_rows(attr_events(s, d), ATTR_EVENTS)
SQL["flatten_row"] = f"""
  WITH t AS (SELECT event_id, CAST(ts AS VARCHAR) AS ts, CAST(event_id AS VARCHAR) AS id, event_type, service, message, CAST(value AS VARCHAR) AS val FROM ({ATTR_EVENTS_SQL})),
  l AS (UNPIVOT t ON id, ts, event_type, service, message, val INTO NAME key VALUE value)
  SELECT event_id, CASE key WHEN 'id' THEN 'event_id' WHEN 'val' THEN 'value' ELSE key END AS key, value,
         CASE key WHEN 'ts' THEN 'time' WHEN 'id' THEN 'number' WHEN 'val' THEN 'number' ELSE 'string' END AS type FROM l
  UNION ALL SELECT event_id, 'attrs.' || e.key, e.value, 'string' FROM (SELECT event_id, unnest(map_entries(attrs)) AS e FROM ({ATTR_EVENTS_SQL}))
  UNION ALL SELECT event_id, 'props.k', json_extract_string(props, '$.k'), 'string' FROM events"""
