"""Volume histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.catalog.common import EVENTS, LINES, ORDERS, table
from loglattice.operators import predicates as P
from loglattice.operators.volume import (
    SEVERITY_ORDER, pivot_volume, rank_levels, severity_rank, volume, volume_totals, volume_vs_previous, zero_fill,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}
FROM, TO = "2024-01-03 07:30:00", "2024-01-20 19:45:00"
RANGE = f"ts >= TIMESTAMP '{FROM}' AND ts <= TIMESTAMP '{TO}'"


def at(step: str, ts: str = "ts") -> str:
    return f"time_bucket(INTERVAL '{step}', {ts}, TIMESTAMP '1970-01-01')"


def events(s, d):
    return table(s, d, "events")


QUERIES["vol_none"] = lambda s, d: volume(events(s, d), EVENTS, "hour")
SQL["vol_none"] = f"SELECT {at('1 hour')} AS time, '' AS level, count(*) AS count FROM events GROUP BY 1"

QUERIES["vol_severity"] = lambda s, d: volume(events(s, d), EVENTS, "hour", by="severity", time=(FROM, TO))
SQL["vol_severity"] = f"SELECT {at('1 hour')} AS time, event_type AS level, count(*) AS count FROM events WHERE {RANGE} GROUP BY 1, 2"
QUERIES["vol_severity_lines"] = lambda s, d: volume(table(s, d, "lineitem"), LINES, "day", by="severity")
SQL["vol_severity_lines"] = f"SELECT {at('1 day', 'l_shipdate')} AS time, l_returnflag AS level, count(*) AS count FROM lineitem GROUP BY 1, 2"

QUERIES["vol_severity_null"] = lambda s, d: volume(
    events(s, d).withColumn("event_type", F.nullif("event_type", F.lit("view"))), EVENTS, "day", by="severity"
)
SQL["vol_severity_null"] = f"""SELECT {at('1 day')} AS time, coalesce(nullif(event_type, 'view'), 'unknown') AS level, count(*) AS count
  FROM events GROUP BY 1, 2"""


def top_sql(source: str, step: str, value: str, n: int) -> str:
    return f"""WITH b AS ({source}), top AS (SELECT {value} AS v, count(*) AS n FROM b GROUP BY 1 ORDER BY n DESC, v ASC NULLS LAST LIMIT {n})
      SELECT {step} AS time, CASE WHEN {value} IN (SELECT v FROM top WHERE v IS NOT NULL) THEN {value} ELSE 'Other' END AS level,
             count(*) AS count FROM b GROUP BY 1, 2"""


QUERIES["vol_field_top"] = lambda s, d: volume(events(s, d), EVENTS, 21600, by="user_id", where=P.gt("value", 5))
SQL["vol_field_top"] = top_sql("SELECT * FROM events WHERE value > 5", at("6 hours"), "CAST(user_id AS VARCHAR)", 10)
QUERIES["vol_field_top_lines"] = lambda s, d: volume(table(s, d, "lineitem"), LINES, "month", by="l_suppkey", top=5)
SQL["vol_field_top_lines"] = top_sql("SELECT * FROM lineitem", "date_trunc('month', l_shipdate)", "CAST(l_suppkey AS VARCHAR)", 5)
QUERIES["vol_field_top_null"] = lambda s, d: volume(
    events(s, d).withColumn("event_type", F.nullif("event_type", F.lit("signup"))), EVENTS, "day", by="event_type", top=3
)
SQL["vol_field_top_null"] = top_sql(
    "SELECT ts, nullif(event_type, 'signup') AS event_type FROM events", at("1 day"), "event_type", 3
)

for unit in ("minute", "hour", "day"):
    QUERIES[f"bucket_fixed_{unit}"] = lambda s, d, unit=unit: volume(events(s, d), EVENTS, unit)
    SQL[f"bucket_fixed_{unit}"] = f"SELECT {at('1 ' + unit)} AS time, '' AS level, count(*) AS count FROM events GROUP BY 1"
QUERIES["bucket_fixed_seconds"] = lambda s, d: volume(events(s, d), EVENTS, 45)
SQL["bucket_fixed_seconds"] = f"SELECT {at('45 seconds')} AS time, '' AS level, count(*) AS count FROM events GROUP BY 1"
for unit in ("week", "month", "year"):
    QUERIES[f"bucket_calendar_{unit}"] = lambda s, d, unit=unit: volume(table(s, d, "orders"), ORDERS, unit, by="severity")
    SQL[f"bucket_calendar_{unit}"] = f"""SELECT CAST(date_trunc('{unit}', o_orderdate) AS TIMESTAMP) AS time, o_orderpriority AS level, count(*) AS count
      FROM orders GROUP BY 1, 2"""

# 17.5 days over sixty buckets is seven hours, so the next step: one day
QUERIES["bucket_auto"] = lambda s, d: volume(events(s, d), EVENTS, "auto", by="severity", time=(FROM, TO))
SQL["bucket_auto"] = f"SELECT {at('1 day')} AS time, event_type AS level, count(*) AS count FROM events WHERE {RANGE} GROUP BY 1, 2"
# 5.5 years over sixty buckets is 33.5 days, so the next step: 90 days
QUERIES["bucket_auto_orders"] = lambda s, d: volume(table(s, d, "orders"), ORDERS, "auto", time=("1995-01-01", "2000-07-01"))
SQL["bucket_auto_orders"] = f"""SELECT {at('90 days', 'o_orderdate')} AS time, '' AS level, count(*) AS count FROM orders
  WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2000-07-01' GROUP BY 1"""


def _zero(s, d):
    rows = events(s, d)
    vol = volume(rows, EVENTS, "minute", by="severity", time=("2024-01-10", "2024-01-10 12:00:00"), where=P.lt("value", 20))
    return zero_fill(vol, "minute", "2024-01-10", "2024-01-10 12:00:00")


QUERIES["vol_zero_fill"] = _zero
SQL["vol_zero_fill"] = f"""
  WITH v AS (SELECT {at('1 minute')} AS time, event_type AS level, count(*) AS count FROM events
             WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-10 12:00:00' AND value < 20 GROUP BY 1, 2)
  SELECT g.time, l.level, coalesce(v.count, 0) AS count
  FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-10 11:59:00', INTERVAL 1 MINUTE)) AS time) g
  CROSS JOIN (SELECT DISTINCT level FROM v) l LEFT JOIN v ON v.time = g.time AND v.level = l.level"""

TYPES = ["click", "error", "purchase", "signup", "view"]
QUERIES["vol_pivot"] = lambda s, d: pivot_volume(volume(events(s, d), EVENTS, "hour", by="severity"), TYPES)
SQL["vol_pivot"] = (
    f"SELECT {at('1 hour')} AS time, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in TYPES) + " FROM events GROUP BY 1"
)

QUERIES["vol_totals"] = lambda s, d: volume_totals(volume(events(s, d), EVENTS, "day", by="severity"))
SQL["vol_totals"] = f"""
  WITH b AS (SELECT {at('1 day')} AS time, event_type AS level FROM events)
  SELECT 'bucket' AS kind, time, NULL AS level, count(*) AS total FROM b GROUP BY time
  UNION ALL SELECT 'level', NULL, level, count(*) FROM b GROUP BY level
  UNION ALL SELECT 'all', NULL, NULL, count(*) FROM b
  UNION ALL SELECT 'max', NULL, NULL, max(n) FROM (SELECT count(*) AS n FROM b GROUP BY time)"""

QUERIES["vol_shift"] = lambda s, d: volume_vs_previous(events(s, d), EVENTS, "2024-01-15 06:00:00", "2024-01-18 00:00:00", "hour")
SQL["vol_shift"] = f"""
  WITH e AS (SELECT ts >= TIMESTAMP '2024-01-15 06:00:00' AS cur, CASE WHEN ts >= TIMESTAMP '2024-01-15 06:00:00' THEN ts ELSE ts + INTERVAL 66 HOUR END AS t
             FROM events WHERE ts >= TIMESTAMP '2024-01-12 12:00:00' AND ts < TIMESTAMP '2024-01-18 00:00:00')
  SELECT {at('1 hour', 't')} AS time, count(*) FILTER (WHERE cur) AS count, count(*) FILTER (WHERE NOT cur) AS previous FROM e GROUP BY 1"""

QUERIES["level_order_sev"] = lambda s, d: (
    volume(events(s, d), EVENTS, "day", by="severity").select("time", "level", "count", severity_rank(F.col("level")).alias("rank"))
)
SQL["level_order_sev"] = f"""SELECT {at('1 day')} AS time, event_type AS level, count(*) AS count,
  CAST(CASE WHEN lower(event_type) = 'error' THEN 3 ELSE {len(SEVERITY_ORDER) + 1} END AS INTEGER) AS rank FROM events GROUP BY 1, 2"""

QUERIES["level_order_cnt"] = lambda s, d: rank_levels(volume(events(s, d), EVENTS, "day", by="user_id", top=10))
SQL["level_order_cnt"] = f"""
  WITH v AS ({top_sql("SELECT * FROM events", at("1 day"), "CAST(user_id AS VARCHAR)", 10)}),
  t AS (SELECT level, CAST(sum(count) AS BIGINT) AS total FROM v GROUP BY level)
  SELECT level, total, CAST(row_number() OVER (ORDER BY level = 'Other', total DESC, level) AS INTEGER) AS rank FROM t"""
