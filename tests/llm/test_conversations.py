"""Prefix trees, repair and resampling against brute force: nulls, long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglattice.llm import chat_tree, conversation_repair, importance
from loglattice.llm.chat_tree import PLAIN, format_conversations, format_digests
from loglattice.llm.conversation_repair import audit, before, damaged, normal, repair, repair_digests

COLUMNS = "conv_id long, turn long, role string, text string, conv long, node string, row int, `there` int, cell int"
SHARED = [
    [(t, "user" if t % 2 == 0 else "assistant", "x" if t < n % 15 else "y.") for t in range(15)] for n in range(30)
]


def _conversations():
    draw = random.Random(2)
    parts = ["a", "b", "###", "### Assistant: ", "</turn>", "\\", ":", "\n", "#", "<", "é", "."]
    text = lambda: draw.choice([None, "", "x", "y.", "".join(draw.choice(parts) for _ in range(4))])
    roles = ["user", "user", "assistant", "assistant", "system", "a:b", "\\", "", None]
    rows = [(c, t, draw.choice(roles), text()) for c in range(250) for t in range(draw.randrange(1, 8))]
    rows += [(1000 + n, *r) for n, turns in enumerate(SHARED) for r in turns]
    rows += [(None, None, None, None), (None, 2, "user", "x"), (None, 2, "assistant", "y."), (5, None, "user", "x")]
    rows += [(6, 3, "user", "again.")] * 4 + [(7, 1, "assistant", "é." * 30000), (7, 2, "assistant", " \t\n " * 5000)]
    rows += [(2000, t, r, x) for t, (r, x) in enumerate(itertools.product(["user", "assistant", "user"], ["one.", "two", " "]))]
    return rows


ROWS = _conversations()


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame([(*r, 1, "n", 2, 3, 4) for r in ROWS], COLUMNS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def _grouped(null):
    """Rows of each conversation by turn (null first), then by the digest of role and text."""
    out = defaultdict(list)
    for c, t, r, x in ROWS:
        out[c].append((t, null if r is None else r, null if x is None else x))
    return {c: sorted(v, key=_order) for c, v in out.items()}


def _order(row):
    t, r, x = row
    return (t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest())


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _formatted(turns):
    sign = lambda s, more="": re.sub(r"\\|###|</turn>" + more, lambda m: "\\" + m[0], s)
    return "".join(f"### {sign(r, '|:')}: {sign(x)}</turn>\n" for _, r, x in turns)


# --- prefix trees -------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 400, 8_000_000])
def test_digests_are_those_of_the_turns(conversations, monkeypatch, block):
    monkeypatch.setattr(chat_tree, "BLOCK_CHARS", block)
    want = {}
    for c, turns in _grouped("").items():
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want[c] = (len(turns), _sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), _sha(loss), len(_formatted(turns)))
    got = [tuple(r) for r in format_digests(conversations).collect()]
    assert len(got) == len(want) and {r[0]: r[1:] for r in got} == want


def test_tree_writes_shared_turns_once_and_spans_read_back(conversations):
    tree = format_conversations(conversations)
    nodes = sorted(tree.nodes.collect(), key=lambda n: n.start)
    text = "".join(n.text for n in nodes)
    grouped = _grouped("")
    assert [n.end for n in nodes] == list(itertools.accumulate(len(n.text) for n in nodes))
    prefixes = {tuple(x[1:] for x in turns[: i + 1]) for turns in grouped.values() for i in range(len(turns))}
    assert len(nodes) == len(prefixes)
    for n in nodes:  # the intervals are the conversation's beginning
        assert sum(a.end - a.start for a in n.attends) == n.position
        assert all(n.tree <= a.start < a.end <= n.start for a in n.attends)
        (turn,) = PLAIN.turns(n.text)
        assert (n.loss_start is not None) == (turn[0] == "assistant")
        if n.loss_start is not None:
            assert PLAIN.plain(text[n.loss_start : n.loss_end]) == turn[1]
    found = {r.conv: "".join(text[s.start : s.end] for s in r.spans) for r in tree.conversations.collect()}
    assert found == {c: _formatted(turns) for c, turns in grouped.items()}
    # depth first: all of a tree lies together
    assert [k for k, _ in itertools.groupby(n.tree for n in nodes)] == sorted({n.tree for n in nodes})


def test_template_is_reversible():
    for parts in itertools.product(["\\", "###", "</turn>", "#", "<", ": ", "x"], repeat=4):
        text = "".join(parts)
        segment = _formatted([(0, text, text)])
        assert list(PLAIN.turns(segment * 2)) == [(text, text)] * 2


def test_no_conversations(empty):
    assert format_digests(empty).count() == 0 and format_conversations(empty).nodes.count() == 0
    assert repair(empty).count() == 0 and repair_digests(damaged(normal(empty))).count() == 0


# --- repair -------------------------------------------------------------------------------------


def _best(turns, faults):
    """Cheapest, then ASCII-least audit, and the rows it leaves, by trying every edit."""

    @lru_cache(None)
    def go(i, last, inserts):
        found = []
        if i == len(turns):
            if last in ("", "a"):
                found.append((0, "", ()))
        else:
            _, role, text = turns[i]
            cost, edits, rows = go(i + 1, last, 0)
            found.append((4 + cost, "D" + edits, rows))
            if faults[i] not in ("blank", "duplicate"):
                late = 3 if faults[i] == "truncated" else 0
                for edit, price, name in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                    if _fits(last, name[:1]):
                        cost, edits, rows = go(i + 1, name[:1], 0)
                        found.append((price + late + cost, edit + edits, (f"{name}:{text}", *rows)))
        if inserts < 3:
            for name in ("user", "assistant"):
                if _fits(last, name[0]):
                    cost, edits, rows = go(i, name[0], inserts + 1)
                    found.append((3 + cost, "I" + edits, (f"{name}:", *rows)))
        return min(found) if found else (10**9, "", ())

    return go(0, "", 0)


def _fits(last, initial):
    return bool(initial) and last + initial in ("s", "u", "su", "ua", "au")


def _repair_truth(conv, turns):
    rows = []
    for t, role, text in turns:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if t is None else t}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            rows += [(t, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    rows.sort(key=_order)
    seen, faults = set(), []
    for _, role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    known = {t for t, _, _ in rows if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    cost, edits, left = _best(rows, faults)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, _sha("\n".join(left)))


def test_repair_agrees_with_brute_force(conversations):
    want = {c: _repair_truth(c, turns) for c, turns in _grouped(" ").items()}
    got = [tuple(r) for r in repair_digests(damaged(normal(conversations))).collect()]
    assert len(got) == len(want) and {r[0]: r[1:] for r in got} == want
    assert any(r[1:] == (0, 0, 0, 0, 0, 0, "", _sha("")) for r in got)  # one that lost all its rows


def test_repaired_rows_are_good_and_need_no_repair(spark, conversations):
    rows = repair(conversations)
    turns = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: r.position):
        turns[r.conv].append(r)
    assert all(re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in v)) for v in turns.values())
    assert all([r.position for r in v] == list(range(len(v))) for v in turns.values())


def test_every_ending_of_short_signatures():
    costs = {"blank": "x", "truncated": str.upper}
    for symbols in itertools.product("suaoUAx", repeat=4):
        nodes = [conversation_repair.END]
        for s in reversed(symbols):
            nodes.append(before(s, nodes[-1]))
        turns = [(0, {"s": "system", "u": "user", "a": "assistant"}.get(s.lower(), "other"), "") for s in symbols]
        faults = ["blank" if s == costs["blank"] else "truncated" if s.isupper() else "" for s in symbols]
        cost, edits, _ = _best(turns, faults)
        assert (nodes[-1][0][0], audit(nodes)) == (cost, edits), symbols


def test_signatures_that_end_alike_share_nodes(spark):
    """Ranges of the sorted endings give what each signature alone gives."""
    all_of = ["".join(p) for n in range(6) for p in itertools.product("uaX", repeat=n)]
    given = spark.createDataFrame([(s,) for s in all_of * 2], "signature string").repartition(7)
    got = {r.signature: (r.cost, r.audit) for r in conversation_repair.solve(given).collect()}
    assert len(got) == len(all_of)
    for s in all_of:
        nodes = [conversation_repair.END]
        for symbol in reversed(s):
            nodes.append(before(symbol, nodes[-1]))
        assert got[s] == (nodes[-1][0][0], audit(nodes))


# --- resampling ---------------------------------------------------------------------------------

TEXTS = [
    None, "", "!!!", "One", "a b c", "A.b-C 12", "é É z", "x " * 60, "long" * 200 + " " + "other" * 90 + " tail", "日本 語 x",
    *(" ".join(random.Random(i).choices(["red", "Green", "blue7", "ñu", "a"], k=15 + i)) for i in range(40)),
]
TARGET = ["red green red green", "blue7 a", None, "", "ñu ñu"]


def _features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]], len(w)


def _resample_truth(docs, target):
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, x in docs:
        np.add.at(s, _features(x)[0], 1)
    for x in target:
        np.add.at(t, _features(x)[0], 1)
    ratio = lambda i: (t[i] + 1) * (s.sum() + 10000) / ((s[i] + 1) * (t.sum() + 10000))
    rows = []
    for d, x in docs:
        f, n = _features(x)
        weight = sum(math.floor(1000 * math.log(ratio(i))) for i in f) // len(f) if f else 0
        h = int(_sha(f"7:{'' if d is None else d}")[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    enough = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(enough[: 25 * len(enough) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("group", [4_000_000, 50])
def test_resample_agrees_with_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(importance, "GROUP_BYTES", group)
    docs = [(i * 2, x) for i, x in enumerate(TEXTS)] + [(20, TEXTS[10])] * 3 + [(None, TEXTS[30])]
    given = spark.createDataFrame([(*d, 1, 2, "x", 3) for d in docs], "doc_id long, text string, weight int, rank int, score string, n int").repartition(4)
    target = spark.createDataFrame([(x, 1) for x in TARGET], "text string, bucket int")
    got = sorted((tuple(r) for r in importance.resample(given, target).collect()), key=repr)
    want = _resample_truth(docs, TARGET)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 1 + sum(r[4] is not None for r in want)))
    top = lambda rows: sorted((r[4], r[3], r[0]) for r in rows if r[4])
    assert top(got) == top(want)
    assert importance.resample(given.limit(0), target).count() == 0
    assert importance.resample(given, target.limit(0)).count() == len(docs)


def test_crcs_join():
    draw = random.Random(5)
    for _ in range(300):
        a, b = draw.randbytes(draw.randrange(9)), draw.randbytes(draw.choice([0, 1, 7, 300, 70000]))
        got = importance.joined_crc(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
        assert int(got[0]) == zlib.crc32(a + b)
