"""Redaction and checks of SQL text, as expressions over a column."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# String literals that are settings keywords and stay readable.
KEPT_LITERALS = ("throw", "break", "any", "browser", "dashboard", "sql", "Table")
REDACTED = "<redacted>"

# What one left-to-right pass over the text has recognised is marked by an escape character and a digit;
# where the text has that character itself, a zero follows it meanwhile.
_ESCAPE = "\ue000"
_OPEN, _CLOSE = _ESCAPE + "1", _ESCAPE + "2"
_KEPT = "|".join(KEPT_LITERALS)
_TOKEN = rf"'({_KEPT})'|(')(?:[^'\\]|\\.)*+'|--[^\n]*|/\*[\s\S]*?\*/"

# What each finding looks for in cleaned text (a word it cannot do without, then the
# pattern), and how serious it is.
FINDINGS = {
    "overflowBreak": (
        "overflow_mode",
        r"(?i)\b(timeout_overflow_mode|read_overflow_mode|result_overflow_mode)\s*=\s*'break'",
        "warning",
    ),
    "groupByAny": ("group_by_overflow_mode", r"(?i)\bgroup_by_overflow_mode\s*=\s*'any'", "warning"),
    "sample": ("sample", r"(?i)\bSAMPLE\b", "info"),
}
LIMIT_PATTERN = r"(?i)\bLIMIT\s+(\d+)"


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def strip_literals(text: Column) -> Column:
    """Comments become a space and string literals ``'<redacted>'``, keyword literals excepted.

    Literals and comments are recognised together from the left, so a comment mark inside a literal
    is text and a quote inside a comment is comment.  One regex pass marks them (a kept literal as
    open-word-close, any other as quote-open-close-quote, a comment as open-close); plain
    replacements do the rest, and text without a quote or comment mark is not scanned at all.
    """
    marked = F.regexp_replace(_swap(text, _ESCAPE, _ESCAPE + "0"), _TOKEN, f"$2{_OPEN}$1{_CLOSE}$2")
    hidden = _swap(marked, f"'{_OPEN}{_CLOSE}'", f"'{REDACTED}'")
    spaced = _swap(hidden, f"{_OPEN}{_CLOSE}", " ")
    done = _swap(_swap(_swap(spaced, _OPEN, "'"), _CLOSE, "'"), _ESCAPE + "0", _ESCAPE)
    marks = [text.contains(m) for m in ("'", "--", "/*")]
    return F.when(reduce(lambda a, b: a | b, marks), done).otherwise(text)


def redact_words(text: Column, words: Iterable[str]) -> Column:
    """Whole-word occurrences of the given names become ``<redacted>``.

    One pass looks for all names, the longest first, so no name is found inside a mark or in what is
    left of a longer one.
    """
    names = sorted({w for w in words if w}, key=lambda w: (-len(w), w))
    if not names:
        return text
    return F.regexp_replace(text, rf"\b(?:{'|'.join(map(re.escape, names))})\b", REDACTED)


# The checks below read text that strip_literals has already cleaned.  Callers keep the cleaned text
# in a column of its own, so it is made once per row however many checks look at it.

def last_limit(clean: Column) -> Column:
    """Row cap of the query's last LIMIT, NULL when it has none."""
    found = F.regexp_extract_all(clean, F.lit(LIMIT_PATTERN), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).try_cast("bigint")


def truncated(clean: Column, rows: Column) -> Column:
    """Whether the result reached its LIMIT; NULL when there is no LIMIT."""
    return rows >= last_limit(clean)


def findings(clean: Column) -> Column:
    """Array of the finding names that apply to a query text."""
    hits = [
        F.when(F.lower(clean).contains(word) & clean.rlike(rx), F.lit(name)) for name, (word, rx, _) in FINDINGS.items()
    ]
    return F.array_compact(F.array(*hits))
