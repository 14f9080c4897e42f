"""Traces and spans.

A span table has ``id, parent_id, root_id, name, kind, start_ms, end_ms, status`` and, where known,
``error`` and ``attrs``.  Roots have ``parent_id`` NULL or ''; ``root_id`` names the tree.  Facts about a
tree are aggregated per root and joined back; no window ever holds a whole tree in one task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions.fields import Scope, quoted
from loglattice.operators.predicates import filter_logs, time_range
from loglattice.plans.durable import durable
from loglattice.plans.joins import HOT_ROWS, join_group_facts
from loglattice.plans.ordered import into_blocks, previous, running_sum
from loglattice.plans.topk import within
from loglattice.view import LogView

SERVER_KIND = "server"
# Span kinds that are phases of a query: fixed values, but for the server's, whose name is a parameter.
PHASES = (SERVER_KIND, "transport", "decode", "render", "build")
TRACE_PAD = "5 minutes"
_HEX = re.compile(r"[0-9a-fA-F]+\Z")


# --- logs and traces ----------------------------------------------------------------------------

def is_hex_id(trace_id: str) -> bool:
    return bool(_HEX.match(trace_id))


def logs_of_trace(df: DataFrame, view: LogView, trace_id: str, time: tuple | None = None, hex_only: bool = True) -> DataFrame:
    """All rows of one trace."""
    view.require("trace_id")
    if hex_only and not is_hex_id(trace_id):
        raise ValueError("a trace id is hexadecimal")
    rows = filter_logs(df, view, time_range(*time)) if time else df
    scope = Scope(rows, view)
    col = scope.role("trace_id")
    return rows.filter(col == F.lit(trace_id).cast(scope.role_type("trace_id")))


def trace_windows(
    spans: DataFrame, trace_id: str = "trace_id", start: str = "start", end: str = "end", pad: str = TRACE_PAD
) -> DataFrame:
    """(trace_id, window_start, window_end, n_rows): each trace's time window, padded on both sides."""
    pad_by = F.expr(f"interval {pad}")
    return (
        spans.groupBy(quoted(trace_id).alias("trace_id"))
        .agg(F.min(quoted(start)).alias("lo"), F.max(quoted(end)).alias("hi"), F.count("*").alias("n_rows"))
        .select("trace_id", (F.col("lo") - pad_by).alias("window_start"), (F.col("hi") + pad_by).alias("window_end"), "n_rows")
    )


def join_logs_traces(
    df: DataFrame, view: LogView, windows: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Log rows joined to their trace's padded window.

    The time span of all windows prunes the log scan.  The equi-key is the trace id; traces with very
    many log rows are spread over several tasks.
    """
    view.require("trace_id", "timestamp")
    scope = Scope(df, view)
    lo = windows.agg(F.min("window_start")).scalar()
    hi = windows.agg(F.max("window_end")).scalar()
    logs = df.filter(within(scope, lo, hi)).withColumn("trace_id", scope.role("trace_id"))
    sizes = logs.groupBy("trace_id").agg(F.count("*").alias("n_rows"))
    facts = windows.drop("n_rows").join(sizes, "trace_id")
    row_hash = F.xxhash64(*[quoted(c) for c in (view.row_id or (view.timestamp,))])
    joined = join_group_facts(logs, facts, "trace_id", row_hash, hot_rows=hot_rows)
    ts = quoted(view.timestamp)
    return joined.filter((ts >= F.col("window_start")) & (ts <= F.col("window_end"))).drop("n_rows")


# --- trees --------------------------------------------------------------------------------------

def no_parent(parent: Column) -> Column:
    """NULL and '' both mean that a span has no parent."""
    return F.coalesce(parent.cast("string"), F.lit("")) == ""


def span_tree(spans: DataFrame, order: Sequence[str] = ("start_ms", "id"), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every span with its depth, depth-first sort path, and whether its root is ``reachable``.

    Spans are known by (root_id, id): an id may come again in another tree.  Path doubling: each span
    points at an ancestor and knows the path from there; one self-join makes every pointer jump twice
    as far, so a tree of depth d takes log2(d) rounds instead of d.  A span whose chain of parents
    breaks off or runs in a circle keeps its row, with NULL depth and path.  The path is an array of
    ``order`` structs from below the root downwards: sorting by (root_id, path) lists a tree depth first
    with children in creation order.
    """
    own = F.array(F.struct(*[quoted(c) for c in order]))
    root = no_parent(F.col("parent_id"))
    key = F.struct(F.col("root_id"), F.col("id"))
    above = F.struct(F.col("root_id"), F.col("parent_id").cast(spans.schema["id"].dataType).alias("id"))
    links = durable(
        spans.select(
            key.alias("__key"),
            F.when(~root, above).alias("up"),  # NULL once the path reaches the root
            F.when(root, F.array().cast(_array_type(spans, order))).otherwise(own).alias("path"),
        )
    )
    done = links.filter(F.col("up").isNull())
    open_ = links.filter(F.col("up").isNotNull())
    longest = spans.groupBy("root_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    while reach <= 2 * longest and not open_.isEmpty():  # what is open then runs in a circle
        sizes = open_.groupBy(F.col("up")).agg(F.count("*").alias("n_rows"))
        ancestors = done.unionByName(open_).select(
            F.col("__key").alias("up"), F.col("up").alias("__next"), F.col("path").alias("__above")
        )
        facts = sizes.join(ancestors, "up")
        joined = join_group_facts(open_, facts, "up", F.xxhash64("__key"), hot_rows=hot_rows)
        moved = durable(joined.select("__key", F.col("__next").alias("up"), F.concat("__above", "path").alias("path")))
        done = done.unionByName(moved.filter(F.col("up").isNull()))
        open_ = moved.filter(F.col("up").isNotNull())
        reach *= 2
    tree = done.select("__key", F.size("path").alias("depth"), "path")
    joined = spans.withColumn("__key", key).join(tree, "__key", "left").drop("__key")
    return joined.withColumn("reachable", F.col("depth").isNotNull())


def otel_spans(
    traces: DataFrame, timestamp: str = "Timestamp", trace_id: str = "TraceId", span_id: str = "SpanId", parent_id: str = "ParentSpanId",
    name: str = "SpanName", kind: str = "SpanKind", duration: str = "Duration", status: str = "StatusCode",
    message: str = "StatusMessage", attributes: str = "SpanAttributes", resource: str = "ResourceAttributes",
) -> DataFrame:
    """An OpenTelemetry trace table as spans.

    The trace id stands for the root.  Durations are nanoseconds; a span without one is running.  The
    span's attributes win over those of its resource.  Columns the table lacks give NULL.
    """
    has = set(traces.columns)
    text = lambda c: quoted(c).cast("string") if c in has else F.lit(None).cast("string")
    ts = quoted(timestamp)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ntz = isinstance(traces.schema[timestamp].dataType, T.TimestampNTZType)
    micros = F.timestamp_diff("MICROSECOND", epoch, ts) if ntz else F.unix_micros(ts.cast("timestamp"))
    start = micros / 1000
    end = start + quoted(duration).cast("double") / 1_000_000 if duration in has else F.lit(None).cast("double")
    failed = F.lower(text(status)).endswith("error")
    maps = [quoted(c) for c in (attributes, resource) if c in has and isinstance(traces.schema[c].dataType, T.MapType)]
    none = F.create_map().cast("map<string,string>")
    given = [F.coalesce(m.cast("map<string,string>"), none) for m in maps]
    attrs = given[0] if given else none
    if len(given) > 1:
        attrs = F.map_concat(F.map_filter(given[1], lambda k, _: ~F.map_contains_key(given[0], k)), given[0])
    return traces.select(
        text(span_id).alias("id"), F.nullif(text(parent_id), F.lit("")).alias("parent_id"), text(trace_id).alias("root_id"),
        text(name).alias("name"), text(kind).alias("kind"), start.alias("start_ms"), end.alias("end_ms"),
        F.when(end.isNull(), "running").when(failed, "error").otherwise("ok").alias("status"),
        F.when(failed, F.nullif(text(message), F.lit(""))).alias("error"), attrs.alias("attrs"),
    )


def _array_type(spans: DataFrame, order: Sequence[str]) -> str:
    inner = ", ".join(f"{c}: {spans.schema[c].dataType.simpleString()}" for c in order)
    return f"array<struct<{inner}>>"


def tree_end(spans: DataFrame) -> DataFrame:
    """(root_id, tree_end_ms, has_running, n_rows); the end is NULL while any span has none."""
    return spans.groupBy("root_id").agg(
        F.when(F.count_if(F.col("end_ms").isNull()) == 0, F.max("end_ms")).alias("tree_end_ms"),
        (F.count_if(F.col("status") == "running") > 0).alias("has_running"),
        F.count("*").alias("n_rows"),
    )


def _tree_facts(spans: DataFrame) -> DataFrame:
    root_start = F.max(F.when(no_parent(F.col("parent_id")), F.col("start_ms")))
    return spans.groupBy("root_id").agg(
        root_start.alias("root_start"),
        F.when(F.count_if(F.col("end_ms").isNull()) == 0, F.max("end_ms")).alias("tree_end"),
        F.count("*").alias("n_rows"),
    )


def waterfall(spans: DataFrame, now_ms: float | Column | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each span's duration, share, offset and width within its tree.

    Trees still running are drawn up to ``now_ms`` (their spans get NULLs when it is not given).
    The tree's total is at least 1 ms; offsets lie in 0..100 and a bar never passes the right edge.
    """
    now = F.lit(None).cast("double") if now_ms is None else (now_ms if isinstance(now_ms, Column) else F.lit(float(now_ms)))
    facts = _tree_facts(spans)
    rows = join_group_facts(spans, facts, "root_id", F.xxhash64("id"), hot_rows=hot_rows)
    zero, hundred = F.lit(0.0), F.lit(100.0)
    end = F.coalesce("tree_end", now)
    total = F.greatest(end - F.col("root_start"), F.lit(1.0))
    duration = F.greatest(F.coalesce("end_ms", now) - F.col("start_ms"), zero)
    rows = rows.withColumn("duration_ms", F.when(F.coalesce("end_ms", now).isNotNull(), duration))
    rows = rows.withColumn("total_ms", F.when((end - F.col("root_start")).isNotNull(), total))
    offset = F.least(F.greatest((F.col("start_ms") - F.col("root_start")) / F.col("total_ms") * 100, zero), hundred)
    rows = rows.withColumn("offset_pct", F.when(F.col("total_ms").isNotNull(), offset))
    share = F.col("duration_ms") / F.col("total_ms") * 100
    width = F.least(F.greatest(share, zero), hundred - F.col("offset_pct"))
    return rows.withColumn("pct", F.floor(share + 0.5).cast("bigint")).withColumn(
        "width_pct", F.when(share.isNotNull(), width)
    ).drop("root_start", "tree_end", "n_rows")


def phase_breakdown(spans: DataFrame, phases: Sequence[str] = PHASES) -> DataFrame:
    """(root_id, kind, total_ms, share_pct): time per phase and its share of all phases of the tree.

    Trees without measured phase time and phases without time give no row.  Phases are a short fixed
    list, so a tree is one row of sums, spread back into rows after the aggregate.
    """
    done = spans.filter(F.col("end_ms").isNotNull() & F.col("kind").isin(*phases))
    length = F.col("end_ms") - F.col("start_ms")
    sums = done.groupBy("root_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == p, length)), F.lit(0)).alias(f"p{i}") for i, p in enumerate(phases)]
    )
    whole = sum((F.col(f"p{i}") for i in range(1, len(phases))), F.col("p0"))
    pairs = F.array(
        *[F.struct(F.lit(p).alias("kind"), F.col(f"p{i}").alias("total_ms")) for i, p in enumerate(phases)]
    )
    rows = sums.withColumn("__whole", whole).filter(F.col("__whole") > 0)
    rows = rows.select("root_id", "__whole", F.inline(pairs)).filter(F.col("total_ms") > 0)
    return rows.select("root_id", "kind", "total_ms", (F.col("total_ms") / F.col("__whole") * 100).alias("share_pct"))


def action_summary(spans: DataFrame, is_query: Column, read_rows: Column | None = None, read_bytes: Column | None = None, now_ms: float | None = None) -> DataFrame:
    """Per root: how long its tree took (never negative), how many query spans, rows and bytes read.

    A tree with a running span is measured up to ``now_ms``, NULL when that is not given.
    """
    now = F.lit(None).cast("double") if now_ms is None else F.lit(float(now_ms))
    rr = F.lit(None).cast("bigint") if read_rows is None else read_rows
    rb = F.lit(None).cast("bigint") if read_bytes is None else read_bytes
    start = F.max(F.when(no_parent(F.col("parent_id")), F.col("start_ms")))
    end = F.when(F.count_if(F.col("end_ms").isNull()) == 0, F.max("end_ms"))
    return spans.groupBy("root_id").agg(
        F.when(F.coalesce(end, now).isNotNull(), F.greatest(F.coalesce(end, now) - start, F.lit(0.0))).alias("duration_ms"),
        F.count_if(is_query).alias("n_queries"),
        F.coalesce(F.sum(F.when(is_query, rr)), F.lit(0)).alias("read_rows"),
        F.coalesce(F.sum(F.when(is_query, rb)), F.lit(0)).alias("read_bytes"),
        (F.count_if(is_query & rr.isNotNull()) > 0).alias("has_server_stats"),
    )


def collapse_runs(
    roots: DataFrame, name: Column, healthy: Column, by: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Merge consecutive healthy rows of one name into one row with a count, in list order.

    An unhealthy row always stands alone.  Output: ``by``, name, ``n`` and the ``order`` values of
    the first row listed.  Runs are found block by block, so one huge group is no single task.
    """
    by, order = list(by), list(order)
    rows = roots.select(*[quoted(c) for c in dict.fromkeys([*by, *order])], name.alias("__name"), healthy.alias("__ok"))
    blocked = into_blocks(rows, by, order)
    me = F.struct("__name", "__ok")
    seen = previous(blocked, me, by, order, "__prev")
    joins = F.col("__ok") & F.col("__prev.__ok") & F.col("__prev.__name").eqNullSafe(F.col("__name"))
    flagged = seen.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).drop("__prev")
    numbered = running_sum(flagged, F.col("__new"), by, order, "run")
    lead = F.min(F.struct(*[quoted(c) for c in order])).alias("__first")
    runs = numbered.groupBy(*by, "run").agg(F.min("__name").alias("name"), F.count("*").alias("n"), lead)
    return runs.select(*by, "run", "name", "n", *[F.col("__first")[c].alias(f"first_{c}") for c in order])
