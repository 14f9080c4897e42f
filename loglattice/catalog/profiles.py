"""Frequent values, map keys, JSON paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.catalog.common import ATTR_EVENTS, ATTR_EVENTS_SQL, DOCS, EVENTS, LINES, attr_events, table
from loglattice.operators import predicates as P
from loglattice.operators.profile import json_paths, json_schema, map_key_counts, map_keys, profile, top_values

QUERIES: dict = {}
SQL: dict[str, str] = {}
NEWEST = "ORDER BY ts DESC NULLS LAST, event_id LIMIT 500"


def top_sql(sample: str, n: int) -> str:
    return f"""
      WITH c AS (SELECT value, count(*) AS count FROM ({sample}) WHERE value IS NOT NULL AND value NOT IN ('', '{{}}', '[]', 'null') GROUP BY value)
      SELECT value, count, CAST(sum(count) OVER () AS BIGINT) AS total, count * 100.0::DOUBLE / sum(count) OVER () AS pct
      FROM c ORDER BY count DESC, value LIMIT {n}"""


QUERIES["top_values"] = lambda s, d: top_values(attr_events(s, d), ATTR_EVENTS, "attrs.http.method", where=P.gt("value", 3))
SQL["top_values"] = top_sql(
    f"SELECT coalesce(attrs['http.method'], '') AS value FROM (SELECT * FROM ({ATTR_EVENTS_SQL}) WHERE value > 3 {NEWEST})", 10
)
QUERIES["top_values_json"] = lambda s, d: top_values(table(s, d, "events"), EVENTS, "props.k", limit=20)
SQL["top_values_json"] = top_sql(f"SELECT json_extract_string(props, '$.k') AS value FROM (SELECT * FROM events {NEWEST})", 20)
QUERIES["top_values_full"] = lambda s, d: top_values(table(s, d, "events"), EVENTS, "user_id", sample=None)
SQL["top_values_full"] = top_sql("SELECT CAST(user_id AS VARCHAR) AS value FROM events", 10)
QUERIES["top_values_lines"] = lambda s, d: top_values(table(s, d, "lineitem"), LINES, "l_partkey", limit=15, sample=None)
SQL["top_values_lines"] = top_sql("SELECT CAST(l_partkey AS VARCHAR) AS value FROM lineitem", 15)


def profile_sql(source: str, fields: str, n: int) -> str:
    return f"""
      WITH t AS ({source}), l AS (UNPIVOT t ON {fields} INTO NAME field VALUE value),
      c AS (SELECT field, value, count(*) AS count FROM l WHERE value NOT IN ('', '{{}}', '[]', 'null') GROUP BY field, value),
      r AS (SELECT *, CAST(sum(count) OVER (PARTITION BY field) AS BIGINT) AS total,
                   CAST(row_number() OVER (PARTITION BY field ORDER BY count DESC, value) AS INTEGER) AS rank FROM c)
      SELECT * FROM r WHERE rank <= {n}"""


EVENT_FIELDS = ["event_id", "ts", "user_id", "event_type", "value", "props.k"]
QUERIES["profile_all"] = lambda s, d: profile(table(s, d, "events"), EVENTS, EVENT_FIELDS, limit=5)
SQL["profile_all"] = profile_sql(
    """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(ts AS VARCHAR) AS ts, CAST(user_id AS VARCHAR) AS user_id, event_type,
              CAST(value AS VARCHAR) AS val, json_extract_string(props, '$.k') AS "props.k" FROM events""",
    'event_id, ts, user_id, event_type, val, "props.k"', 5,
).replace("SELECT * FROM r", "SELECT * REPLACE (CASE field WHEN 'val' THEN 'value' ELSE field END AS field) FROM r")
QUERIES["profile_docs"] = lambda s, d: profile(table(s, d, "documents"), DOCS, limit=3)
SQL["profile_docs"] = profile_sql(
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents",
    "doc_id, text, lang, source, n_chars", 3,
)

QUERIES["map_keys"] = lambda s, d: map_keys(attr_events(s, d), ATTR_EVENTS, "attrs", where=P.eq("event_type", "click"))
SQL["map_keys"] = f"""WITH n AS (SELECT attrs FROM ({ATTR_EVENTS_SQL}) WHERE event_type = 'click' {NEWEST})
  SELECT DISTINCT unnest(map_keys(attrs)) AS key, (SELECT count(*) FROM n) AS total FROM n"""
QUERIES["map_key_counts"] = lambda s, d: map_key_counts(attr_events(s, d), "attrs")
SQL["map_key_counts"] = f"SELECT k AS key, count(*) AS count FROM (SELECT unnest(map_keys(attrs)) AS k FROM ({ATTR_EVENTS_SQL})) GROUP BY k"

# nested documents built from event columns
NESTED_SQL = """SELECT event_id, '{"user":{"id":' || user_id || ',"name":"u' || user_id || '"},"props":' || props ||
  CASE WHEN event_id % 3 = 0 THEN ',"tags":["a",{"b":1}],"gone":null' ELSE '' END ||
  CASE WHEN event_id % 10 = 0 THEN ',"deep":{"x":{"y":{"z":true}}},"empty":{}' ELSE '' END || '}' AS payload FROM events"""


def nested(s, d):
    e = table(s, d, "events")
    user = F.col("user_id").cast("string")
    third = F.when(F.col("event_id") % 3 == 0, ',"tags":["a",{"b":1}],"gone":null').otherwise("")
    tenth = F.when(F.col("event_id") % 10 == 0, ',"deep":{"x":{"y":{"z":true}}},"empty":{}').otherwise("")
    text = F.concat(F.lit('{"user":{"id":'), user, F.lit(',"name":"u'), user, F.lit('"},"props":'), "props", third, tenth, F.lit("}"))
    return e.select("event_id", text.alias("payload"))


LEAF_PATHS = {
    "user.id": "TRUE", "user.name": "TRUE", "props.k": "TRUE", "tags": "event_id % 3 = 0", "gone": "event_id % 3 = 0",
    "deep.x.y.z": "event_id % 10 = 0",
}
QUERIES["json_paths"] = lambda s, d: json_paths(nested(s, d), "payload").select("path", "count")
SQL["json_paths"] = " UNION ALL ".join(
    f"SELECT '{p}' AS path, count(*) AS count FROM ({NESTED_SQL}) WHERE {c}" for p, c in LEAF_PATHS.items()
)
QUERIES["json_path_types"] = lambda s, d: json_paths(nested(s, d), "payload").select("path", "type")
TYPES = {
    "user.id": "BIGINT", "user.name": "STRING", "props.k": "BIGINT", "tags": "ARRAY<VARIANT>", "gone": "VOID", "deep.x.y.z": "BOOLEAN",
}
SQL["json_path_types"] = " UNION ALL ".join(
    f"SELECT '{p}' AS path, '{t}' AS type FROM events WHERE event_id % 30 = 0 GROUP BY 1, 2" for p, t in TYPES.items()
)
QUERIES["json_schema"] = lambda s, d: json_schema(table(s, d, "events"), "props")
SQL["json_schema"] = "SELECT 'OBJECT<k: BIGINT>' AS type FROM events HAVING count(*) = count(json_extract(props, '$.k'))"
