"""Saved searches evaluated together: every row, or every stream record, is read once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.functions.fields import Scope, quoted
from loglattice.functions.tokens import Needs, words
from loglattice.operators.predicates import BodyTest, Predicate
from loglattice.view import LogView


def _bound(df: DataFrame, view: LogView, rules: Mapping[str, Predicate]):
    scope = Scope(df, view)
    for name, p in rules.items():
        col = p.bind(scope)
        yield name, (F.lit(True) if col is None else col)


def tag_matches(df: DataFrame, view: LogView, rules: Mapping[str, Predicate], out: str = "rules") -> DataFrame:
    """Each row with the names of the rules it meets, in the order the rules are given."""
    tags = [F.when(col, F.lit(name)) for name, col in _bound(df, view, rules)]
    return df.withColumn(out, F.array_compact(F.array(*tags)))


def count_matches(df: DataFrame, view: LogView, rules: Mapping[str, Predicate]) -> DataFrame:
    """(rule, count) for every rule, also those nothing meets: one pass, one row per task shuffled."""
    bound = list(_bound(df, view, rules))
    wide = df.agg(*[F.count_if(col).alias(f"c{i}") for i, (_, col) in enumerate(bound)])
    pairs = [F.struct(F.lit(name).alias("rule"), F.col(f"c{i}").alias("count")) for i, (name, _) in enumerate(bound)]
    return wide.select(F.inline(F.array(*pairs)))


# --- very many rules ----------------------------------------------------------------------------

RULE_TABLE = "token string, rule string, likes array<string>, no_likes array<string>, texts array<string>, no_texts array<string>"
#: rules whose index is sent to every executor: a few hundred bytes each
MOST_RULES = 100_000


def _words_of(needs: Needs) -> set[str]:
    """Words that a body must hold as a whole, each of them."""
    if needs is None or needs[0] == "any":
        return set()
    if needs[0] == "has":
        return {needs[1][2:]} if needs[1].startswith("t:") else set()
    return set().union(*map(_words_of, needs[1]))


def _rule_table(rules: Mapping[str, list[tuple[BodyTest, ...]]]) -> tuple[list[tuple], list[str]]:
    """A row of the rule table for each alternative, and the rules of which one holds no word for sure.

    An alternative is listed under the one of its words that the fewest alternatives hold.
    """
    sure = {name: [set().union(*(_words_of(t.needs) for t in clause if t.wanted)) for clause in clauses] for name, clauses in rules.items()}
    often = Counter(w for found in sure.values() for words_ in found for w in words_)
    listed, loose = [], []
    for name, clauses in rules.items():
        if not all(sure[name]):
            loose.append(name)
            continue
        for clause, own in zip(clauses, sure[name]):
            token = min(own, key=lambda w: (often[w], -len(w), w))
            sorts = [[t.pattern for t in clause if t.like == like and t.wanted == wanted] for like in (True, False) for wanted in (True, False)]
            listed.append((token, name, *sorts))
    return listed, loose


def match_rules(df: DataFrame, view: LogView, rules: Mapping[str, Predicate], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys or row_id, rule): which row meets which rule, at a cost that hardly grows with the number of rules.

    Each alternative of a rule names a word that the body must hold as a whole, the one that the fewest other rules name.  Rows meet rules by their
    words, and only the pairs that meet are tested, by the rule's patterns as data; the index of at most MOST_RULES rules is
    broadcast.  Rules that name no such word (a part of a word, a negation, a test of another field) are evaluated on every
    row, as ``tag_matches`` does: their number does count.  Rows that meet nothing give nothing; equal rows give equal pairs,
    each as often as it is there.
    """
    keys = keys or view.row_id
    if not keys:
        raise ValueError("match_rules needs key columns")
    scope = Scope(df, view)
    written_out = {name: rule.clauses(scope) for name, rule in rules.items()}
    listed, wordless = _rule_table({name: c for name, c in written_out.items() if c is not None})
    if len(listed) > MOST_RULES:
        raise ValueError(f"the rules have {len(listed)} alternatives; at most {MOST_RULES} go into one index")
    wordless = {*wordless, *(name for name, c in written_out.items() if c is None)}
    loose = {name: rule for name, rule in rules.items() if name in wordless}
    names = [quoted(k) for k in keys]
    out = tag_matches(df, view, loose, "__rules").select(*names, F.explode("__rules").alias("rule"))
    if not listed:
        return out
    index = df.sparkSession.createDataFrame(listed, RULE_TABLE)
    body = scope.role("body")
    rows = df.select(F.struct(*names).alias("__row"), F.monotonically_increasing_id().alias("__n"), body.alias("__body"))
    met = rows.select("*", F.explode(words(F.col("__body"))).alias("token")).join(F.broadcast(index), "token")
    like, fits = (lambda p: F.ilike(F.col("__body"), p)), (lambda p: F.rlike(F.col("__body"), p))
    good = F.forall("likes", like) & F.forall("no_likes", lambda p: ~like(p)) & F.forall("texts", fits) & F.forall("no_texts", lambda p: ~fits(p))
    # alternatives of one rule may fit one row twice
    pairs = met.filter(good).groupBy("__n", "rule").agg(F.first("__row").alias("__row"))
    return out.unionByName(pairs.select(*[F.col("__row")[k].alias(k) for k in keys], "rule"))
