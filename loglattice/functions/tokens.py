"""Words of a text and what a search for a piece of text asks of them.

A word is a run of ASCII letters, digits and underscores, case folded as the phrase search folds it.  A
search asks for *elements*: ``t:word`` for a word that must stand there as a whole, ``g:abc`` for three
neighbouring characters that must stand in some word.  What must be there is a formula:
``("has", element)``, ``("all", formulas)``, ``("any", formulas)``, or None where nothing is known.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters beyond A-Z that a case-insensitive search takes for an ASCII letter.
FOLDED = {"İ": "i", "ı": "i", "ſ": "s", "K": "k"}
_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(FOLDED)
_TO = "abcdefghijklmnopqrstuvwxyz" + "".join(FOLDED.values())
GRAM = 3

Needs = tuple | None


def words(text: Column) -> Column:
    """The distinct words of a text."""
    return F.filter(F.array_distinct(F.split(F.translate(text, _FROM, _TO), "[^a-z0-9_]+")), lambda w: w != "")


def elements(word: Column) -> Column:
    """All elements that a word meets."""
    grams = F.when(
        F.length(word) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(word) - (GRAM - 1)), lambda i: F.concat(F.lit("g:"), F.substr(word, i, F.lit(GRAM))))
    ).otherwise(F.array())
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("t:"), word)), grams))


def all_needed(parts: list[Needs]) -> Needs:
    known = tuple(p for p in parts if p is not None)
    return ("all", known) if known else None


def any_needed(parts: list[Needs]) -> Needs:
    return ("any", tuple(parts)) if parts and all(p is not None for p in parts) else None


def needed(text: str, begins: bool, ends: bool) -> Needs:
    """What a text asks for; ``begins`` and ``ends`` say that no word reaches over that edge of it.

    A character that is not ASCII is taken for neither an edge nor a part of a word: folding may change it.
    """
    text = "".join(c.lower() if c.isascii() else c for c in text)
    found: list[Needs] = []
    for run in re.finditer(r"[a-z0-9_]+", text):
        left, right = text[run.start() - 1 : run.start()], text[run.end() : run.end() + 1]
        if (left.isascii() if left else begins) and (right.isascii() if right else ends):
            found.append(("has", f"t:{run[0]}"))
        else:
            found += [("has", f"g:{run[0][i : i + GRAM]}") for i in range(len(run[0]) - GRAM + 1)]
    return all_needed(list(dict.fromkeys(found)))


def needed_by_wildcard(pattern: str) -> Needs:
    """A pattern with ``*`` covers the whole value, so its own ends are edges."""
    parts = pattern.split("*")
    last = len(parts) - 1
    return all_needed([needed(p, begins=i == 0, ends=i == last) for i, p in enumerate(parts)])


def asked(formula: Needs) -> list[str]:
    """The elements of a formula, each once."""
    if formula is None:
        return []
    if formula[0] == "has":
        return [formula[1]]
    return list(dict.fromkeys(e for part in formula[1] for e in asked(part)))


def holds(formula: Needs, has) -> Column:
    """The formula over the columns that ``has(element)`` gives."""
    if formula is None:
        return F.lit(True)
    if formula[0] == "has":
        return has(formula[1])
    out = None
    for part in formula[1]:
        c = holds(part, has)
        out = c if out is None else (out & c if formula[0] == "all" else out | c)
    return F.lit(formula[0] == "all") if out is None else out
