"""The query log beside the spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.catalog.common import PREFIX, QLOG_SQL, SPANS_SQL, query_log, spans, table
from loglattice.functions.text import strip_literals
from loglattice.operators.querylog import (
    audit_sql, correlate, correlation_status, efficiency_report, parse_tag, query_log_for, redact, split_server_time, warnings, with_truncation,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = "2024-01-18 09:00:00"
FINAL = "('QueryFinish', 'ExceptionWhileProcessing', 'ExceptionBeforeStart')"
TAG = "CAST(split_part(log_comment, '|', 2) AS BIGINT) AS trace_id, CAST(split_part(log_comment, '|', 3) AS BIGINT) AS span_id"

QUERIES["qlog_select"] = lambda s, d: query_log_for(
    query_log(s, d), spans(s, d).select(F.col("root_id").cast("string").alias("trace_id")).distinct(), NOW, PREFIX, minutes=60 * 24 * 7
).select("query_id", "event_time", "trace_id", "span_id", "op")
SQL["qlog_select"] = f"""SELECT query_id, event_time, split_part(log_comment, '|', 2) AS trace_id, split_part(log_comment, '|', 3) AS span_id,
    split_part(log_comment, '|', 4) AS op FROM ({QLOG_SQL})
  WHERE event_time >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND type IN {FINAL}
  ORDER BY event_time DESC, query_id LIMIT 200"""


def _failing_roots(s, d):
    bad = spans(s, d).filter(F.col("status") == "error")
    return bad.select(F.col("root_id").cast("string").alias("trace_id")).distinct()


QUERIES["qlog_select_semi"] = lambda s, d: query_log_for(
    query_log(s, d), _failing_roots(s, d), NOW, PREFIX, minutes=60 * 24 * 30, limit=None
).select("query_id", "trace_id")
SQL["qlog_select_semi"] = f"""SELECT query_id, split_part(log_comment, '|', 2) AS trace_id FROM ({QLOG_SQL})
  WHERE event_time >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND type IN {FINAL}
    AND CAST(split_part(log_comment, '|', 2) AS BIGINT) IN (SELECT root_id FROM ({SPANS_SQL}) WHERE status = 'error')"""


def logged(s, d):
    """Finished rows with typed trace and span ids; a fifth of the spans has none."""
    q = query_log(s, d)
    tag = parse_tag(F.col("log_comment"))
    q = q.withColumns({k: tag[k].cast("bigint") for k in ("trace_id", "span_id")})
    return q.filter((F.col("type") != "QueryStart") & (F.col("span_id") % 5 != 0))


LOGGED_SQL = f"SELECT *, {TAG} FROM ({QLOG_SQL}) WHERE type <> 'QueryStart' AND query_id // 10 % 5 <> 0"
FIRST_SQL = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, span_id ORDER BY event_time, query_id) AS rn FROM ({LOGGED_SQL})) WHERE rn = 1"
CORRELATED_SQL = f"""SELECT s.*, q.query_id AS server_query_id, q.query_duration_ms AS server_query_duration_ms, q.read_rows AS server_read_rows,
    q.exception_code AS server_exception_code, q.span_id IS NOT NULL AS matched
  FROM ({SPANS_SQL}) s LEFT JOIN ({FIRST_SQL}) q ON s.root_id = q.trace_id AND s.id = q.span_id"""


def correlated(s, d):
    return correlate(spans(s, d), logged(s, d), ["query_id", "query_duration_ms", "read_rows", "exception_code"])


QUERIES["qlog_join"] = correlated
SQL["qlog_join"] = CORRELATED_SQL
QUERIES["qlog_status"] = lambda s, d: correlation_status(
    spans(s, d), logged(s, d).filter(F.col("trace_id") % 192 != 0), F.col("root_id") % 320 != 0
)
SQL["qlog_status"] = f"""
  SELECT r.root_id, CASE WHEN r.root_id % 320 = 0 THEN 'not-tagged' WHEN q.n IS NOT NULL THEN 'ok' ELSE 'no-data' END AS status,
         coalesce(q.n, 0) AS n_log_rows
  FROM (SELECT DISTINCT root_id FROM ({SPANS_SQL})) r
  LEFT JOIN (SELECT trace_id, count(*) AS n FROM ({LOGGED_SQL}) WHERE trace_id % 192 <> 0 GROUP BY trace_id) q ON r.root_id = q.trace_id"""

QUERIES["server_split"] = lambda s, d: split_server_time(correlated(s, d))
SQL["server_split"] = f"""
  WITH c AS ({CORRELATED_SQL}),
  k AS (SELECT parent_id, min(start_ms) FILTER (WHERE kind = 'decode') AS ds, bool_or(kind = 'server') AS hs
        FROM c WHERE kind IN ('decode', 'server') AND parent_id IS NOT NULL GROUP BY parent_id),
  t AS (SELECT c.id, c.root_id, c.start_ms, coalesce(k.ds, c.end_ms) AS edge, CAST(c.server_query_duration_ms AS DOUBLE) AS dur
        FROM c LEFT JOIN k ON c.id = k.parent_id WHERE c.end_ms IS NOT NULL AND c.server_query_duration_ms > 0 AND NOT coalesce(k.hs, FALSE)),
  p AS (SELECT *, edge - least(dur, edge - start_ms) AS cut FROM t WHERE edge > start_ms)
  SELECT id AS parent_id, root_id, 'server' AS kind, cut AS start_ms, edge AS end_ms FROM p
  UNION ALL SELECT id, root_id, 'transport', start_ms, cut FROM p WHERE cut > start_ms"""

QUERIES["read_efficiency"] = lambda s, d: efficiency_report(
    query_log(s, d).withColumn("hour", F.date_trunc("hour", "event_time").cast("timestamp_ntz")), F.col("op"), F.col("hour")
).withColumn("efficiency_pct", F.round("efficiency_pct", 6))
SQL["read_efficiency"] = f"""
  SELECT op, date_trunc('hour', event_time) AS hour, count(*) AS n_queries, CAST(sum(read_rows) AS BIGINT) AS read_rows,
         CAST(sum(result_rows) AS BIGINT) AS result_rows,
         count(*) FILTER (WHERE read_rows > 0 AND result_rows / read_rows * 100 < 1) AS n_low,
         round(CASE WHEN sum(read_rows) > 0 THEN CAST(sum(result_rows) AS DOUBLE) / CAST(sum(read_rows) AS DOUBLE) * 100 END, 6) AS efficiency_pct
  FROM ({QLOG_SQL}) GROUP BY 1, 2"""

# --- text ---------------------------------------------------------------------------------------

KEPT = "throw|break|any|browser|dashboard|sql|Table"


def strip_sql(text: str) -> str:
    a, b = "chr(57344)", "chr(57345)"
    marked = (
        f"regexp_replace(replace(replace({text}, {a}, ''), {b}, ''), "
        rf"'''({KEPT})''|('')(?:[^''\\]|\\.)*''|--[^\n]*|/\*(?:.|\n)*?\*/', '\2' || {a} || '\1' || {b} || '\2', 'g')"
    )
    hidden = f"replace({marked}, '''' || {a} || {b} || '''', '''<redacted>''')"
    kept = rf"regexp_replace({hidden}, {a} || '({KEPT})' || {b}, '''\1''', 'g')"
    return f"replace({kept}, {a} || {b}, ' ')"


QUERIES["strip_literals"] = lambda s, d: query_log(s, d).select("query_id", strip_literals(F.col("query")).alias("query"))
SQL["strip_literals"] = f"SELECT query_id, clean AS query FROM ({QLOG_SQL})"
QUERIES["strip_literals_docs"] = lambda s, d: redact(table(s, d, "documents").select("doc_id", "text"), "text")
SQL["strip_literals_docs"] = f"SELECT doc_id, {strip_sql('text')} AS text FROM documents"
QUERIES["redact_ident"] = lambda s, d: redact(query_log(s, d), "query", ["shop", "click", ""]).select("query_id", "query")
SQL["redact_ident"] = rf"""SELECT query_id, regexp_replace(regexp_replace(clean, '\bshop\b', '<redacted>', 'g'), '\bclick\b', '<redacted>', 'g') AS query
  FROM ({QLOG_SQL})"""
QUERIES["redact_pages"] = lambda s, d: redact(table(s, d, "pages").select("page_id", "html"), "html", ["div", "class", "p", "div class"], literals=False)
SQL["redact_pages"] = r"""SELECT page_id, regexp_replace(html, '\b(?:div class|class|div|p)\b', '<redacted>', 'g') AS html FROM pages"""
QUERIES["redact_ident_docs"] = lambda s, d: redact(table(s, d, "documents").select("doc_id", "text"), "text", ["the", "and"], literals=False)
SQL["redact_ident_docs"] = r"""SELECT doc_id, regexp_replace(regexp_replace(text, '\bthe\b', '<redacted>', 'g'), '\band\b', '<redacted>', 'g') AS text FROM documents"""

LIMIT_SQL = rf"CAST(list_last(regexp_extract_all(clean, '(?i)\bLIMIT\s+(\d+)', 1)) AS BIGINT)"
QUERIES["truncation"] = lambda s, d: with_truncation(query_log(s, d), "query", "result_rows").select(
    "query_id", "row_limit", "truncated"
)
SQL["truncation"] = f"SELECT query_id, {LIMIT_SQL} AS row_limit, result_rows >= {LIMIT_SQL} AS truncated FROM ({QLOG_SQL})"

MODE = r"(?i)\b(timeout_overflow_mode|read_overflow_mode|result_overflow_mode)\s*=\s*''break''"
FOUND_SQL = rf"""
  SELECT * FROM (SELECT *, unnest([
      CASE WHEN regexp_matches(clean, '{MODE}') THEN 'overflowBreak' END,
      CASE WHEN regexp_matches(clean, '(?i)\bgroup_by_overflow_mode\s*=\s*''any''') THEN 'groupByAny' END,
      CASE WHEN regexp_matches(clean, '(?i)\bSAMPLE\b') THEN 'sample' END]) AS finding
  FROM ({QLOG_SQL})) WHERE finding IS NOT NULL"""
QUERIES["sql_findings"] = lambda s, d: audit_sql(query_log(s, d), "query", F.col("op"))
SQL["sql_findings"] = f"SELECT op, finding, count(*) AS count FROM ({FOUND_SQL}) GROUP BY op, finding"


def query_spans(s, d):
    """The query log itself as spans: each logged query is one query span."""
    q = query_log(s, d)
    tag = parse_tag(F.col("log_comment"))
    full = with_truncation(q, "query", "result_rows")
    kind = F.when(F.col("op") == "view", "columns").otherwise(F.col("op"))
    failed = (F.col("op") == "error") & (F.col("query_id") % 2 == 0)
    return full.select(
        tag["trace_id"].cast("bigint").alias("root_id"),
        F.col("query_id").alias("id"),
        F.col("op").alias("name"),
        kind.alias("kind"),
        F.when(failed, "error").otherwise("ok").alias("status"),
        F.when(failed, "boom").alias("error"),
        F.col("query").alias("sql"),
        "truncated",
        F.col("exception_code").alias("server_exception_code"),
        F.when(F.col("exception_code") != 0, "memory limit").alias("server_exception"),
    )


QUERIES["warn_all"] = lambda s, d: warnings(query_spans(s, d))
BASE = "CAST(split_part(log_comment, '|', 2) AS BIGINT) AS root_id, query_id AS span_id, op AS name"
SQL["warn_all"] = f"""
  WITH q AS (SELECT *, op = 'error' AND query_id % 2 = 0 AS failed FROM ({QLOG_SQL}))
  SELECT {BASE}, CASE finding WHEN 'sample' THEN 'info' ELSE 'warning' END AS severity,
         CAST(CASE finding WHEN 'sample' THEN 2 ELSE 1 END AS INTEGER) AS rank, finding, CAST(NULL AS VARCHAR) AS detail FROM ({FOUND_SQL})
  UNION ALL SELECT {BASE}, 'info', 2, 'truncated', NULL FROM q WHERE op = 'view' AND result_rows >= {LIMIT_SQL}
  UNION ALL SELECT {BASE}, 'error', 0, 'serverException', 'memory limit' FROM q WHERE exception_code <> 0 AND NOT failed
  UNION ALL SELECT {BASE}, 'error', 0, 'failed', 'boom' FROM q WHERE failed"""
