"""Very many rules, against the expression form."""

import random

import pytest
from pyspark.sql import functions as F

from loglattice import LogView, P
from loglattice.functions.fields import Scope
from loglattice.operators import rules as rules_module
from loglattice.operators.rules import match_rules, tag_matches

VIEW = LogView(body="body", row_id=("id",))
BODIES = [
    "payment failed for req-59", "PAYMENT ok req-592", "100% done", "a_b", "axb", "it's fine", "", None, "abcſ tail", "K8s node İce", "one two three",
    "one, two: three", "error: disk full on node-7", "error: net", "a.b*c (x) [y]", "ends with \\E quoted",
]
RULES = {
    "phrase": P.phrase("payment"), "two": P.phrase("one two"), "or": P.phrase("done") | P.phrase("fine"), "and": P.phrase("error") & P.phrase("node-7"),
    "but": P.phrase("error") & ~P.phrase("net"), "not both": P.phrase("payment") & ~(P.phrase("failed") & P.term("59")), "inside": P.term(" disk "),
    "word and part": P.phrase("payment") & P.term("592"), "wild": P.wildcard("error: *"), "wild words": P.wildcard("* failed *"), "folded": P.phrase("k8s"),
    "ice": P.phrase("ice"), "signs": P.phrase("a.b*c"), "quote": P.phrase("\\E"), "percent": P.term("0% d"), "part": P.term("aymen"), "none": ~P.phrase("error"),
    "other": P.gt("id", 5), "mixed": P.phrase("error") & P.gt("id", 12), "field": P.eq("body", "full on"), "either": P.phrase("tail") | P.gt("id", 14),
    "twice": P.phrase("one") | P.phrase("two") | P.phrase("three"), "all": P.term(""), "many": (P.phrase("a") | P.phrase("one")) & (P.phrase("b") | P.phrase("two")),
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, b, "x") for i, b in enumerate(BODIES)] + [(0, BODIES[0], "x")], "id long, body string, rule string").repartition(3)


def _pairs(df, rules):
    return sorted((r.id, x) for r in tag_matches(df, VIEW, rules, "found").collect() for x in r.found)


def test_pairs_are_those_of_the_expressions(rows):
    got = match_rules(rows, VIEW, RULES)
    assert got.columns == ["id", "rule"]
    assert sorted(map(tuple, got.collect())) == _pairs(rows, RULES)


def test_random_rules(rows):
    draw = random.Random(7)
    words = ["payment", "error", "one", "two", "req-59", "net", "done", "a_b", "node", "x"]

    def some(depth):
        kind = draw.randrange(6 if depth else 3)
        w = draw.choice(words)
        if kind < 3:
            return (P.phrase(w), P.term(w), P.wildcard(f"*{w}*"))[kind]
        return some(depth - 1) & some(depth - 1) if kind == 3 else some(depth - 1) | some(depth - 1) if kind == 4 else ~some(depth - 1)

    rules = {f"r{i}": some(3) for i in range(60)}
    assert sorted(map(tuple, match_rules(rows, VIEW, rules).collect())) == _pairs(rows, rules)


def test_rules_are_listed_under_their_rarest_word(rows):
    scope = Scope(rows, VIEW)
    rules = {f"u{i}": P.phrase(f"req-{i}") for i in range(50)}
    listed, loose = rules_module._rule_table({n: r.clauses(scope) for n, r in rules.items()})
    assert not loose and [r[0] for r in listed] == [str(i) for i in range(50)]
    listed, loose = rules_module._rule_table({n: RULES[n].clauses(scope) for n in ("part", "none", "or", "all")})
    assert loose == ["part", "none", "all"] and {r[1] for r in listed} == {"or"}
    assert RULES["other"].clauses(scope) is None and RULES["mixed"].clauses(scope) is None


def test_the_plan_does_not_grow_with_the_rules(rows, plan):
    few, many = (len(plan(match_rules(rows, VIEW, {f"u{i}": P.phrase(f"req-{i}") for i in range(n)}))) for n in (10, 3000))
    assert many < 1.2 * few


def test_nothing_to_match(spark, rows):
    assert match_rules(rows, VIEW, {}).count() == 0
    assert match_rules(rows.limit(0), VIEW, RULES).count() == 0
    with pytest.raises(ValueError):
        match_rules(rows, VIEW.with_(row_id=()), RULES)
    assert match_rules(rows.filter(F.col("id") == 14), VIEW, {"a": P.phrase("x"), "b": P.phrase("y")}, keys=("body",)).count() == 2
