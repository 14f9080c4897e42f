"""A server's query log beside the spans that caused the queries.

Query-log rows carry a tag ``prefix|trace|span|op`` in a comment column.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions.fields import quoted
from loglattice.functions.literals import timestamp_literal, naive_utc
from loglattice.functions.text import FINDINGS, findings, last_limit, redact_words, strip_literals
from loglattice.operators.traces import SERVER_KIND

# Event types that end a query.
FINAL_TYPES = ("QueryFinish", "ExceptionWhileProcessing", "ExceptionBeforeStart")
LOOKBACK_MINUTES = 10
MAX_ROWS = 200
LOW_EFFICIENCY_PCT = 1.0

# Operations whose results have no paging, so reaching the LIMIT hides data.
UNPAGED_OPS = ("mapKeys", "jsonPaths", "fieldValues", "columns")
# Order of severity of warnings.
WARNING_RANK = {"error": 0, "warning": 1, "info": 2}

STAT_COLUMNS = (
    "query_id", "query_duration_ms", "read_rows", "read_bytes", "result_rows", "memory_usage",
    "selected_marks", "selected_parts", "selected_ranges", "os_read_bytes", "exception_code", "exception",
)


def parse_tag(comment: Column) -> dict[str, Column]:
    """Trace, span and operation of a tag; a missing part is NULL."""
    parts = F.split(comment, r"\|")
    names = ("trace_id", "span_id", "op")
    return {n: F.nullif(F.try_element_at(parts, F.lit(i + 2)), F.lit("")) for i, n in enumerate(names)}


def query_log_for(
    qlog: DataFrame,
    traces: Sequence[str] | DataFrame | None,
    now,
    prefix: str,
    comment: str = "log_comment",
    minutes: int = LOOKBACK_MINUTES,
    limit: int | None = MAX_ROWS,
) -> DataFrame:
    """Finished, tagged queries of the given traces in the last minutes, newest first up to ``limit``.

    ``traces`` is a short list, a DataFrame with a ``trace_id`` column of any size, or None for all.
    """
    at = naive_utc(now)
    etype = qlog.schema["event_time"].dataType
    recent = qlog.filter(
        (F.col("event_time") >= timestamp_literal(at - dt.timedelta(minutes=minutes), etype))
        & quoted(comment).startswith(f"{prefix}|")
        & F.col("type").isin(*FINAL_TYPES)
    )
    tagged = recent.withColumns(parse_tag(quoted(comment)))
    tagged = tagged.filter(F.col("trace_id").isNotNull() & F.col("span_id").isNotNull())
    if isinstance(traces, DataFrame):
        tagged = tagged.join(traces.select("trace_id"), "trace_id", "left_semi")
    elif traces is not None:
        tagged = tagged.filter(F.col("trace_id").isin(*traces)) if traces else tagged.filter(F.lit(False))
    if limit is None:
        return tagged
    return tagged.orderBy(F.desc("event_time"), F.asc("query_id")).limit(limit)


def correlate(spans: DataFrame, qlog: DataFrame, stats: Sequence[str] = STAT_COLUMNS) -> DataFrame:
    """Spans with the server statistics of their query as ``server_<column>``, at most one row each.

    Of several rows for one span the earliest counts.  ``qlog`` has trace_id, span_id, event_time
    and query_id.  Rows are reduced per (trace, span) before the join, so both sides are unique.
    """
    stats = [c for c in stats if c in qlog.columns]
    first = F.min_by(F.struct(*[quoted(c) for c in stats]), F.struct("event_time", "query_id"))
    one = qlog.groupBy(F.col("trace_id").alias("root_id"), F.col("span_id").alias("id")).agg(first.alias("__s"))
    one = one.select("root_id", "id", *[quoted("__s", c).alias(f"server_{c}") for c in stats], F.lit(True).alias("matched"))
    return spans.join(one, ["root_id", "id"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def correlation_status(spans: DataFrame, qlog: DataFrame, tagged: Column | None = None) -> DataFrame:
    """(root_id, status): 'ok' when the log knows the trace, 'no-data' when not, 'not-tagged' when
    ``tagged`` says its queries carried no tag."""
    flag = F.lit(True) if tagged is None else tagged
    roots = spans.groupBy("root_id").agg(F.bool_or(flag).alias("tagged"))
    known = qlog.groupBy(F.col("trace_id").alias("root_id")).agg(F.count("*").alias("n_log_rows"))
    status = (
        F.when(~F.col("tagged"), "not-tagged").when(F.col("n_log_rows").isNotNull(), "ok").otherwise("no-data")
    )
    return roots.join(known, "root_id", "left").select(
        "root_id", status.alias("status"), F.coalesce("n_log_rows", F.lit(0)).alias("n_log_rows")
    )


def split_server_time(
    spans: DataFrame, duration: str = "server_query_duration_ms", server_kind: str = SERVER_KIND
) -> DataFrame:
    """Transport and server parts of every finished query span with a server duration.

    The server part ends where decoding starts (else where the span ends), is as long as the server
    says but no longer than the time available; what is left in front is transport.  Spans already
    split, or with no time before decoding, give nothing.
    """
    kids = (
        spans.filter(F.col("kind").isin("decode", server_kind))
        .groupBy("root_id", F.col("parent_id").alias("id"))
        .agg(
            F.min(F.when(F.col("kind") == "decode", F.col("start_ms"))).alias("decode_start"),
            F.bool_or(F.col("kind") == server_kind).alias("has_server"),
        )
    )
    todo = spans.filter(F.col("end_ms").isNotNull() & (quoted(duration) > 0)).join(kids, ["root_id", "id"], "left")
    edge = F.coalesce("decode_start", "end_ms")
    todo = todo.filter(~F.coalesce("has_server", F.lit(False))).withColumn("__edge", edge.cast("double"))
    todo = todo.filter(F.col("__edge") > F.col("start_ms"))
    cut = F.col("__edge") - F.least(quoted(duration).cast("double"), F.col("__edge") - F.col("start_ms"))
    start = F.col("start_ms").cast("double")

    def part(kind: str, lo: Column, hi: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), lo.alias("start_ms"), hi.alias("end_ms"))

    parts = F.array_compact(
        F.array(F.when(cut > start, part("transport", start, cut)), part(server_kind, cut, F.col("__edge")))
    )
    return todo.select(F.col("id").alias("parent_id"), "root_id", F.inline(parts))


def read_efficiency(read_rows: Column, result_rows: Column) -> Column:
    """Returned rows as a percentage of rows read; NULL when nothing was read."""
    return F.when(read_rows > 0, result_rows / read_rows * 100)


def efficiency_report(qlog: DataFrame, op: Column, hour: Column) -> DataFrame:
    """Per operation and hour: queries, rows read and returned, efficiency, how many were below 1 %."""
    eff = read_efficiency(F.col("read_rows"), F.col("result_rows"))
    return (
        qlog.groupBy(op.alias("op"), hour.alias("hour"))
        .agg(
            F.count("*").alias("n_queries"),
            F.sum("read_rows").alias("read_rows"),
            F.sum("result_rows").alias("result_rows"),
            F.count_if(eff < LOW_EFFICIENCY_PCT).alias("n_low"),
        )
        .withColumn("efficiency_pct", read_efficiency(F.col("read_rows"), F.col("result_rows")))
    )


def warnings(spans: DataFrame, unpaged_ops: Sequence[str] = UNPAGED_OPS) -> DataFrame:
    """Findings of every span: (root_id, span_id, name, severity, rank, finding, detail).

    ``spans`` may carry ``sql``, ``executed_sql``, ``truncated``, ``server_exception_code``,
    ``server_exception`` and ``error``; absent columns count as NULL.  Only spans with ``sql`` are
    queries.  Each span is judged by itself, so this is a narrow pass with no shuffle.
    """

    def col(name: str, dtype: str = "string") -> Column:
        return quoted(name) if name in spans.columns else F.lit(None).cast(dtype)

    is_query = col("sql").isNotNull()
    text = F.coalesce(col("executed_sql"), col("sql"))

    def item(severity: Column | str, finding: Column | str, detail: Column) -> Column:
        sev = F.lit(severity) if isinstance(severity, str) else severity
        name = F.lit(finding) if isinstance(finding, str) else finding
        return F.struct(sev.alias("severity"), name.alias("finding"), detail.alias("detail"))

    none = F.lit(None).cast("string")
    sev_of = F.create_map(*[x for k, (_, _, s) in FINDINGS.items() for x in (F.lit(k), F.lit(s))])
    audit = F.transform(
        F.when(is_query, findings(F.col("__clean"))).otherwise(F.array().cast("array<string>")),
        lambda k: item(F.element_at(sev_of, k), k, none),
    )
    code = col("server_exception_code", "bigint")
    hidden = is_query & (F.coalesce(code, F.lit(0)) != 0) & ~F.col("status").eqNullSafe("error")
    capped = is_query & F.coalesce(col("truncated", "boolean"), F.lit(False)) & F.col("kind").isin(*unpaged_ops)
    rest = F.array_compact(
        F.array(
            F.when(capped, item("info", "truncated", none)),
            F.when(hidden, item("error", "serverException", col("server_exception"))),
            F.when(F.col("status") == "error", item("error", "failed", col("error"))),
        )
    )
    rank = F.create_map(*[x for k, v in WARNING_RANK.items() for x in (F.lit(k), F.lit(v))])
    cleaned = spans.withColumn("__clean", strip_literals(text))
    found = cleaned.select("root_id", F.col("id").alias("span_id"), "name", F.inline(F.concat(audit, rest)))
    return found.select(
        "root_id", "span_id", "name", "severity", F.element_at(rank, F.col("severity")).alias("rank"), "finding", "detail"
    )


def audit_sql(qlog: DataFrame, column: str, op: Column) -> DataFrame:
    """(op, finding, count) over a query-log text column."""
    return (
        qlog.select(op.alias("op"), strip_literals(quoted(column)).alias("__clean"))
        .select("op", F.explode(findings(F.col("__clean"))).alias("finding"))
        .groupBy("op", "finding")
        .agg(F.count("*").alias("count"))
    )


def redact(df: DataFrame, column: str, words: Sequence[str] = (), literals: bool = True) -> DataFrame:
    """The text column with literals and comments removed and the given names blotted out."""
    text = strip_literals(quoted(column)) if literals else quoted(column)
    return df.withColumn(column, redact_words(text, words))


def with_truncation(qlog: DataFrame, sql: str, rows: str, out: str = "truncated", limit_out: str = "row_limit") -> DataFrame:
    """Adds the row cap of each query text and whether its result reached it; NULL without a LIMIT."""
    capped = qlog.withColumn(limit_out, last_limit(strip_literals(quoted(sql))))
    return capped.withColumn(out, quoted(rows) >= quoted(limit_out))
