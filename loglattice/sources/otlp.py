"""Collector payloads (OTLP as JSON, a request a line) to the flat log and span tables.

A request nests resources, scopes and records.  Each level is opened once, and what a level says of all
below it (attributes, schema, service) is worked out before the level below is opened.  The same
expressions serve batches and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: levels of lists and maps inside a value that become plain JSON; deeper ones keep the form they came in
DEPTH = 3

# Names of the span kinds and status codes by number.
SPAN_KINDS = ("Unspecified", "Internal", "Server", "Client", "Producer", "Consumer")
STATUS_CODES = ("Unset", "Ok", "Error")
SERVICE = "service.name"


def _any(depth: int) -> str:
    """Type of a value; numbers are read as the text they have."""
    plain = "stringValue string, boolValue string, intValue string, doubleValue string, bytesValue string"
    if depth == 0:
        return f"struct<{plain}, arrayValue string, kvlistValue string>"
    inner = _any(depth - 1)
    return f"struct<{plain}, arrayValue struct<values array<{inner}>>, kvlistValue struct<values array<struct<key string, value {inner}>>>>"


def _attributes_type(depth: int) -> str:
    return f"array<struct<key string, value {_any(depth)}>>"


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _json(value: Column, depth: int) -> Column:
    """A value as plain JSON."""
    array, pairs = value["arrayValue"], value["kvlistValue"]
    if depth:
        items = F.transform(F.coalesce(array["values"], F.array().cast(f"array<{_any(depth - 1)}>")), lambda v: _json(v, depth - 1))
        listed = F.when(array.isNotNull(), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
        none = F.array().cast(f"array<struct<key string, value {_any(depth - 1)}>>")
        members = F.transform(
            F.coalesce(pairs["values"], none), lambda p: F.concat(_quoted(F.coalesce(p["key"], F.lit(""))), F.lit(":"), _json(p["value"], depth - 1))
        )
        mapped = F.when(pairs.isNotNull(), F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")))
    else:
        listed, mapped = array, pairs
    text = F.coalesce(value["stringValue"], value["bytesValue"])
    return F.coalesce(
        F.when(text.isNotNull(), _quoted(text)), value["boolValue"], value["intValue"], value["doubleValue"], listed, mapped, F.lit("null")
    )


def _text(value: Column, depth: int) -> Column:
    """A value as an attribute holds it: strings and bytes as they are, the rest as JSON, the empty value as ''."""
    plain = F.coalesce(value["stringValue"], value["bytesValue"], value["boolValue"], value["intValue"], value["doubleValue"])
    nested = F.when(value["arrayValue"].isNotNull() | value["kvlistValue"].isNotNull(), _json(value, depth))
    return F.coalesce(plain, nested, F.lit(""))


def _attributes(pairs: Column, depth: int) -> Column:
    """Attributes as a map; of a key that comes again the first counts, a missing list is an empty map."""
    known = F.filter(F.coalesce(pairs, F.array().cast(_attributes_type(depth))), lambda p: p["key"].isNotNull())
    keys = F.transform(known, lambda p: p["key"])
    first = F.filter(known, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    return F.map_from_arrays(F.transform(first, lambda p: p["key"]), F.transform(first, lambda p: _text(p["value"], depth)))


def _moment(nanos: Column) -> Column:
    return F.timestamp_micros(F.floor(nanos.try_cast("decimal(20,0)") / 1000).cast("bigint"))


def _nanos(c: Column) -> Column:
    return F.nullif(c, F.lit("0"))


def _named(code: Column, names: tuple[str, ...], prefix: str) -> Column:
    """A code by number, or by its long name."""
    known = {str(i): n for i, n in enumerate(names)} | {f"{prefix}{n.upper()}": n for n in names}
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), code)
    return F.coalesce(found, F.lit(names[0]))


def _records(payloads: DataFrame, column: str, name: str, record: str, depth: int) -> DataFrame:
    """One row a record: ``r``, with ResourceAttributes, ResourceSchemaUrl, ServiceName and the scope's columns."""
    lower, items = name[0].lower() + name[1:], {"Logs": "logRecords", "Spans": "spans"}[name]
    scope = f"struct<name string, version string, attributes {_attributes_type(depth)}>"
    scopes = f"array<struct<scope {scope}, schemaUrl string, {items} array<{record}>>>"
    resources = f"array<struct<resource struct<attributes {_attributes_type(depth)}>, schemaUrl string, scope{name} {scopes}>>"
    opened = payloads.select(F.from_json(F.col(column), f"resource{name} {resources}").alias("p"))
    each = opened.select(F.explode(f"p.resource{name}").alias("x"))
    each = each.select(
        _attributes(F.col("x.resource.attributes"), depth).alias("ResourceAttributes"), F.coalesce("x.schemaUrl", F.lit("")).alias("ResourceSchemaUrl"),
        F.explode(f"x.scope{name}").alias("s"),
    )
    service = F.coalesce(F.try_element_at("ResourceAttributes", F.lit(SERVICE)), F.lit(""))
    return each.select(
        "ResourceAttributes", "ResourceSchemaUrl", service.alias("ServiceName"),
        _attributes(F.col("s.scope.attributes"), depth).alias("ScopeAttributes"), F.coalesce("s.schemaUrl", F.lit("")).alias("ScopeSchemaUrl"),
        F.coalesce("s.scope.name", F.lit("")).alias("ScopeName"), F.coalesce("s.scope.version", F.lit("")).alias("ScopeVersion"),
        F.explode(f"s.{items}").alias("r"),
    )


def _text_of(field: str) -> Column:
    return F.coalesce(F.col(f"r.{field}"), F.lit(""))


def otlp_logs(payloads: DataFrame, column: str = "value", depth: int = DEPTH) -> DataFrame:
    """The log table's rows of requests for logs, a JSON text each.

    A record without a time has the time it was observed, else none.  Times are cut to microseconds.  Values become text as
    the attribute maps hold it; lists and maps become JSON, down to ``depth`` levels, and keep their wire form below.  A null or
    malformed payload and one of another kind give no rows (see :func:`otlp_malformed`); records that come again stay.
    """
    record = (
        f"struct<timeUnixNano string, observedTimeUnixNano string, severityNumber string, severityText string, body {_any(depth)}, "
        f"attributes {_attributes_type(depth)}, flags bigint, traceId string, spanId string>"
    )
    rows = _records(payloads, column, "Logs", record, depth)
    at = _moment(F.coalesce(_nanos(F.col("r.timeUnixNano")), _nanos(F.col("r.observedTimeUnixNano"))))
    number = F.coalesce(F.col("r.severityNumber").try_cast("int"), F.lit(0))
    return rows.select(
        at.alias("Timestamp"), F.date_trunc("second", at).alias("TimestampTime"), _text_of("traceId").alias("TraceId"), _text_of("spanId").alias("SpanId"),
        F.coalesce("r.flags", F.lit(0).cast("bigint")).alias("TraceFlags"), _text_of("severityText").alias("SeverityText"),
        number.alias("SeverityNumber"), "ServiceName", F.coalesce(_text(F.col("r.body"), depth), F.lit("")).alias("Body"),
        "ResourceSchemaUrl", "ResourceAttributes", "ScopeSchemaUrl", "ScopeName", "ScopeVersion", "ScopeAttributes",
        _attributes(F.col("r.attributes"), depth).alias("LogAttributes"),
    )


def otlp_spans(payloads: DataFrame, column: str = "value", depth: int = DEPTH) -> DataFrame:
    """The trace table's rows of requests for spans; what :func:`otlp_logs` says of values and payloads holds here too.

    Duration is in nanoseconds, null while a span has no end.
    """
    event = f"struct<timeUnixNano string, name string, attributes {_attributes_type(depth)}>"
    link = f"struct<traceId string, spanId string, traceState string, attributes {_attributes_type(depth)}>"
    record = (
        "struct<traceId string, spanId string, parentSpanId string, traceState string, name string, kind string, startTimeUnixNano string, "
        f"endTimeUnixNano string, attributes {_attributes_type(depth)}, events array<{event}>, links array<{link}>, "
        "status struct<message string, code string>>"
    )
    rows = _records(payloads, column, "Spans", record, depth)
    start, end = (_nanos(F.col(f"r.{x}TimeUnixNano")).try_cast("decimal(20,0)") for x in ("start", "end"))
    none = F.array()
    events = F.transform(
        F.coalesce("r.events", none.cast(f"array<{event}>")),
        lambda e: F.struct(_moment(e["timeUnixNano"]).alias("Timestamp"), F.coalesce(e["name"], F.lit("")).alias("Name"), _attributes(e["attributes"], depth).alias("Attributes")),
    )
    text = lambda x: F.coalesce(x, F.lit(""))
    links = F.transform(
        F.coalesce("r.links", none.cast(f"array<{link}>")),
        lambda x: F.struct(
            text(x["traceId"]).alias("TraceId"), text(x["spanId"]).alias("SpanId"), text(x["traceState"]).alias("TraceState"),
            _attributes(x["attributes"], depth).alias("Attributes"),
        ),
    )
    return rows.select(
        _moment(F.col("r.startTimeUnixNano")).alias("Timestamp"), _text_of("traceId").alias("TraceId"), _text_of("spanId").alias("SpanId"),
        _text_of("parentSpanId").alias("ParentSpanId"), _text_of("traceState").alias("TraceState"), _text_of("name").alias("SpanName"),
        _named(F.col("r.kind"), SPAN_KINDS, "SPAN_KIND_").alias("SpanKind"), "ServiceName", "ResourceAttributes", "ScopeName", "ScopeVersion",
        _attributes(F.col("r.attributes"), depth).alias("SpanAttributes"), (end - start).cast("bigint").alias("Duration"),
        _named(F.col("r.status.code"), STATUS_CODES, "STATUS_CODE_").alias("StatusCode"), _text_of("status.message").alias("StatusMessage"),
        events.alias("Events"), links.alias("Links"),
    )


def otlp_malformed(payloads: DataFrame, column: str = "value") -> DataFrame:
    """The payloads that are no request for logs or spans, as they came."""
    kind = lambda name: F.coalesce(F.substring(F.get_json_object(F.col(column), f"$.resource{name}"), 1, 1) == "[", F.lit(False))
    return payloads.filter(~(kind("Logs") | kind("Spans")))
