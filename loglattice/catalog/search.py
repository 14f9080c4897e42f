"""Predicates and filters over the given tables."""

from __future__ import annotations

from loglattice.catalog.common import ATTR_EVENTS, ATTR_EVENTS_SQL, DOCS, EVENTS, TURNS, attr_events, table
from loglattice.operators import predicates as P
from loglattice.operators.filters import Filter, apply_filters, cell_filter
from loglattice.operators.predicates import filter_logs
from loglattice.operators.rules import count_matches, tag_matches, match_rules
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}

DOC_COLS = ("doc_id", "lang", "source", "n_chars")


def docs(key, predicate, where):
    QUERIES[key] = lambda s, d: filter_logs(table(s, d, "documents"), DOCS, predicate).select(*DOC_COLS)
    SQL[key] = f"SELECT doc_id, lang, source, n_chars FROM documents WHERE {where}"


def attrs(key, predicate, where):
    QUERIES[key] = lambda s, d: filter_logs(attr_events(s, d), ATTR_EVENTS, predicate).select("event_id", "message", "value")
    SQL[key] = f"SELECT event_id, message, value FROM ({ATTR_EVENTS_SQL}) WHERE {where}"


def attr_filters(key, filters, where):
    QUERIES[key] = lambda s, d: apply_filters(attr_events(s, d), ATTR_EVENTS, filters).select("event_id", "message", "value")
    SQL[key] = f"SELECT event_id, message, value FROM ({ATTR_EVENTS_SQL}) WHERE {where}"


def mapped(key: str) -> str:
    return f"coalesce(attrs['{key}'], '')"


FROM, TO = "2024-01-05 13:00:00", "2024-01-19 02:30:00"

QUERIES["p_time"] = lambda s, d: filter_logs(table(s, d, "events"), EVENTS, P.time_range(FROM, TO))
SQL["p_time"] = f"SELECT * FROM events WHERE ts >= TIMESTAMP '{FROM}' AND ts <= TIMESTAMP '{TO}'"

docs("p_term", P.term("tion the"), r"text ILIKE '%tion the%'")
attrs("p_term_escaped", P.term("took_3%"), r"message ILIKE '%took\_3\%%' ESCAPE '\'")
docs("p_phrase", P.phrase("the in"), "regexp_matches(text, '(?i)(^|[^a-zA-Z0-9_])the in([^a-zA-Z0-9_]|$)')")
attrs("p_phrase_id", P.phrase("req-14"), "regexp_matches(message, '(?i)(^|[^a-zA-Z0-9_])req-14([^a-zA-Z0-9_]|$)')")
attrs("p_phrase_field", P.phrase("purchase", "attrs.http.method"), f"{mapped('http.method')} = 'purchase'")
docs("p_wildcard", P.wildcard("th*ing*"), "text ILIKE 'th%ing%'")
attrs("p_wildcard_field", P.wildcard("/U/1*", "attrs.http.url"), f"{mapped('http.url')} ILIKE '/U/1%'")
docs("p_eq", P.eq("lang", "fr") & P.eq("source", "src3"), "lang = 'fr' AND source = 'src3'")
docs("p_eq_body", P.eq("text", "Ention"), "text ILIKE '%ention%'")
attrs("p_eq_map", P.eq("attrs.bucket", 3), f"{mapped('bucket')} = '3'")
attrs("p_eq_json", P.eq("props.k", "42"), "json_extract_string(props, '$.k') = '42'")
attrs("p_eq_null", P.eq("props.missing", "null") & P.eq("event_type", "view"), "json_extract_string(props, '$.missing') IS NULL AND event_type = 'view'")
attrs("p_exists", P.exists("attrs.http.url") & P.exists("attrs"), f"{mapped('http.url')} <> ''")
attrs("p_range", P.gt("attrs.latency", "1000") & P.lte("value", 50), f"TRY_CAST({mapped('latency')} AS DOUBLE) > 1000 AND value <= 50")
attrs("p_range_json", P.gte("props.k", 90) & P.lt("service", "5"), "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 90 AND TRY_CAST(service AS DOUBLE) < 5")
attrs("p_range_text", P.gt("event_type", "purchase"), "event_type > 'purchase'")
docs("p_in_list", P.values("lang", "fr", ("or", "de"), ("or", "es")), "lang IN ('fr', 'de', 'es')")
docs(
    "p_in_list_folded",
    P.values("source", "src1", ("or", "src2"), ("and", P.negate_value("src2"))),
    "((source = 'src1') OR (source = 'src2')) AND NOT (source = 'src2')",
)
attrs("p_field_wild", P.any_field("s*", lambda f: P.eq(f, "12")), "service = '12'")
attrs("p_field_wild_none", ~P.any_field("nope.*", lambda f: P.eq(f, "12")), "NOT FALSE")
docs("p_and_or_not", (P.term("the") & ~P.eq("lang", "en")) | P.phrase("and"),
     "(text ILIKE '%the%' AND NOT (lang = 'en')) OR regexp_matches(text, '(?i)(^|[^a-zA-Z0-9_])and([^a-zA-Z0-9_]|$)')")
attrs("p_body_fallback", P.eq("error", " req-7", on_unresolved="body"), "message ILIKE '%error: req-7%'")
attrs(
    "p_all",
    P.where((FROM, TO), P.term("req-1") & P.lt("value", 100), [Filter("event_type", "!=", "view"), Filter("attrs.bucket", "not_exists")]),
    f"ts BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}' AND message ILIKE '%req-1%' AND value < 100 "
    f"AND event_type <> 'view' AND NOT ({mapped('bucket')} <> '')",
)

attr_filters("f_is", [Filter("event_type", "=", " click ")], "event_type = 'click'")
attr_filters("f_is_body", [Filter("message", "=", "REQ-1")], "message ILIKE '%req-1%'")
attr_filters("f_is_not", [Filter("event_type", "!=", "click"), Filter("event_type", "!=", "view")], "event_type <> 'click' AND event_type <> 'view'")
attr_filters("f_is_not_body", [Filter("message", "!=", "req-1")], "message NOT ILIKE '%req-1%'")
attr_filters("f_contains", [Filter("message", "contains", "REQ-1%took_5")], "message ILIKE '%REQ-1%took_5%'")
attr_filters("f_not_contains", [Filter("attrs.http.url", "not_contains", "/u/1")], f"{mapped('http.url')} NOT ILIKE '%/u/1%'")
attr_filters("f_one_of", [Filter("service", "one_of", values=["1", "2", "30"])], "service IN ('1', '2', '30')")
attr_filters("f_one_of_empty", [Filter("service", "one_of")], "1 = 0")
attr_filters("f_not_one_of", [Filter("service", "not_one_of", values=["1", "2", "30"]), Filter("value", "one_of", "6.55", disabled=True)], "service NOT IN ('1', '2', '30')")
attr_filters("f_exists", [Filter("attrs.http.method", "exists")], f"{mapped('http.method')} <> ''")
attr_filters("f_not_exists", [Filter("attrs.http.method", "not_exists")], f"{mapped('http.method')} = ''")
attr_filters("f_cell", [cell_filter("event_type", "error"), cell_filter("service", "12", include=False)], "event_type = 'error' AND service <> '12'")

RULES = {
    "errors": P.eq("event_type", "error"),
    "slow": P.gt("attrs.latency", 1500),
    "user-14": P.phrase("req-14"),
    "odd": P.term("took_9%") & ~P.eq("event_type", "view"),
}
RULES_SQL = {
    "errors": "event_type = 'error'",
    "slow": f"coalesce(TRY_CAST({mapped('latency')} AS DOUBLE) > 1500, FALSE)",
    "user-14": "regexp_matches(message, '(?i)(^|[^a-zA-Z0-9_])req-14([^a-zA-Z0-9_]|$)')",
    "odd": r"(message ILIKE '%took\_9\%%' ESCAPE '\' AND event_type <> 'view')",
}
QUERIES["tag_rules"] = lambda s, d: tag_matches(attr_events(s, d), ATTR_EVENTS, RULES).select(
    "event_id", F.array_join("rules", ",").alias("rules")
)
SQL["tag_rules"] = (
    "SELECT event_id, concat_ws(',', "
    + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in RULES_SQL.items())
    + f") AS rules FROM ({ATTR_EVENTS_SQL})"
)
QUERIES["tag_rules_count"] = lambda s, d: count_matches(attr_events(s, d), ATTR_EVENTS, RULES)
SQL["tag_rules_count"] = " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {c}) AS count FROM ({ATTR_EVENTS_SQL})" for n, c in RULES_SQL.items()
)
QUERIES["p_body_ignored"] = lambda s, d: filter_logs(table(s, d, "events"), EVENTS, P.term("x") & ~P.term("y") & P.eq("event_type", "view"))
SQL["p_body_ignored"] = "SELECT * FROM events WHERE event_type = 'view'"


# --- five thousand rules, indexed by a word of each; the last two are tested on every row ---------

MANY_RULES = {f"u{i}": P.phrase(f"req-{i}") & ~P.term("took_3%") for i in range(5000)}
MANY_RULES |= {"odd": P.phrase("click: req-5") | P.wildcard("error: * took_7%"), "part": P.term("ignup"), "large": P.gt("value", 100)}
QUERIES["tag_rules_many"] = lambda s, d: match_rules(attr_events(s, d), ATTR_EVENTS, MANY_RULES)
SQL["tag_rules_many"] = """
  SELECT event_id, 'u' || user_id AS rule FROM events WHERE user_id < 5000 AND event_id % 10 <> 3
  UNION ALL SELECT event_id, 'odd' FROM events WHERE (event_type = 'click' AND user_id = 5) OR (event_type = 'error' AND event_id % 10 = 7)
  UNION ALL SELECT event_id, 'part' FROM events WHERE event_type = 'signup'
  UNION ALL SELECT event_id, 'large' FROM events WHERE value > 100"""
