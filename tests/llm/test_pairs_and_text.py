"""Operators on whole texts against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loglattice.llm import fingerprints, packing, sentencepiece_bpe, simhash_trie, substring_fm, suffix_dedup
from loglattice.llm.components import components
from loglattice.llm.queries import tokenizer_file
from loglattice.plans import durable

WORDS = "the of and in to river market engine garden winter signal letter harbour method village copper window paper".split()


def _texts():
    draw = random.Random(1)
    say = lambda n: " ".join(draw.choice(WORDS) + draw.choice(("", "", ",", ".")) for _ in range(n))
    passage = say(60)
    long_ = say(4000)
    base = say(150)
    near = base.split()
    near[70] = "changed"
    return [
        None, "", "a", "a b", "   ", base, base, " ".join(near), say(80) + "\n" + passage + "\n" + say(30),
        passage + " " + say(50), say(20) + passage, long_, long_ + " tail", "ab" * 300, "ab" * 200, "x " * 100,
        "Ünï cödé 梦 ﬁ <s> \x00 ’   end", "tab\tand\nlines\r\n\n  two", passage, say(36), "!!! %%% A,B.C", base.upper(),
    ]


TEXTS = _texts()
COLUMNS = "doc_id long, text string, n_chars long, ids string, fingerprint long, row string, m int, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(15, TEXTS[5])]  # the last repeats a row
    return spark.createDataFrame([(d, t, len(t or ""), "x", 1, "y", 2, "z") for d, t in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def _by_id(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append(tuple(r)[1:])
    assert all(len(set(v)) == 1 for v in out.values())
    return {k: v[0] for k, v in out.items()}


def _raw(t):
    return (t or "").encode()


def _words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", _raw(t))


def test_sentencepiece_equals_the_library(docs, empty):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepiece_bpe.encode(docs.select("doc_id", "text", "ids"), path).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert r["ids"] == lib.encode(r["text"]) and r["decoded"] == lib.decode(lib.encode(r["text"]))
    digests = _by_id(sentencepiece_bpe.encode_digests(docs, path).collect())
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "")
        want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[3 * i][:2] == (len(ids), want)
    assert sentencepiece_bpe.encode_digests(empty, path).count() == 0


def test_agenda_of_long_units_equals_that_of_short_ones():
    v = sentencepiece_bpe.vocabulary(tokenizer_file("piece_bpe_32k.model"))
    units = ["▁" + "".join(random.Random(n).choices("etaoinshrdlu▁é梦", k=n)) for n in range(1, 39)]
    assert v.encode_side_by_side(units) == [v.encode_unit(u) for u in units]


def test_packing_covers_every_id_once(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for i, t in enumerate(TEXTS):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        own = sorted({(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces[3 * i]})
        assert [o[0] for o in own] == np.cumsum([0] + [o[1] for o in own])[:-1].tolist() and sum(o[1] for o in own) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c and total == len(ids) for s, n, c, total in own)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty, path).count() == 0
    packed = packing.pack_sequences(docs, path, window=64).collect()
    assert sum(len(r["ids"]) for r in packed) == sum(r["length"] for r in rows)
    for r in packed:
        n = len(r["ids"])
        assert n == sum(r["lengths"]) <= 64 and r["padding"] == (0 if n & (n - 1) == 0 else 64 - n)


def test_best_fit_takes_the_tightest_window():
    where, offset = packing.best_fit(np.array([5, 3, 8, 2, 4, 1]), 10)
    used = Counter()
    for w, n in zip(where, [5, 3, 8, 2, 4, 1]):
        used[w] += n
    assert sorted(used.values()) == [3, 10, 10] or sum(used.values()) == 23
    assert used[where[2]] == 10 and where[3] == where[2]  # 2 goes to the window that 8 left 2 of


def test_simhash_components_equal_brute_force(docs, empty):
    prints = {}
    for i, t in enumerate(TEXTS):
        w = _words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        s = [b" ".join(w[j : j + 3]) for j in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints[3 * i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {d: d for d in prints}
    for a in sorted(prints):
        for b in sorted(prints):
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = (min(root[a], root[b]), max(root[a], root[b]))
                root = {d: x if r == y else r for d, r in root.items()}
    got = _by_id(simhash_trie.near_components(docs).select("doc_id", "fingerprint", "component_id").collect())
    assert got == {d: (f"{prints[d]:016x}", root[d]) for d in prints}
    assert simhash_trie.near_components(empty).count() == 0


@pytest.mark.parametrize("cell", [10_000, 40])
def test_trie_join_finds_all_near_signatures(spark, cell):
    draw = random.Random(5)
    centre = draw.getrandbits(64)
    values = {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 5))) for _ in range(120)}
    values |= {draw.getrandbits(64) for _ in range(80)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    sigs = spark.createDataFrame([(v, [v], [v]) for v in signed], "id long, sig array<long>, pieces array<long>")
    links = components(simhash_trie.near_links(sigs, simhash_trie.EXACT, cell), "a", "b")
    got = {r["node"]: r["component"] for r in links.collect()}
    root = {v: v for v in signed}
    for a in signed:
        for b in signed:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3 and root[a] != root[b]:
                x, y = min(root[a], root[b]), max(root[a], root[b])
                root = {d: x if r == y else r for d, r in root.items()}
    sizes = Counter(root.values())
    assert got == {v: r for v, r in root.items() if sizes[r] > 1}


def test_similar_texts_leave_one(spark, docs, empty):
    draw = random.Random(9)
    words = [f"w{draw.randint(0, 10**6)}" for _ in range(200)]
    family = []
    for n in range(6):
        own = list(words)
        own[10 + 25 * n] = f"new{n}"  # each edit changes 5 of 196 shingles
        family.append(" ".join(own))
    other = [" ".join(f"w{draw.randint(0, 10**6)}" for _ in range(200)) for _ in range(3)]
    half = " ".join(words[:100] + [f"v{i}" for i in range(100)])
    rows = [(i, t) for i, t in enumerate([*family, *other, half, family[0].upper(), None, "", "one", "one"])] + [(None, "kept"), (0, family[0])]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r["doc_id"] for r in simhash_trie.keep_one_of_similar(table).collect()), key=lambda d: -1 if d is None else d)
    assert got == [None, 0, 6, 7, 8, 9, 11, 13]
    assert simhash_trie.keep_one_of_similar(empty).columns == empty.columns


def test_a_repeated_passage_makes_no_text_similar(spark):
    """Shared passages of a few shingles, repeated many times, outvote what the texts do not share."""
    cycle = ("p1 p2 p3 p4 p5 " * 100).strip()
    own = lambda n: " ".join(f"t{n}w{i}" for i in range(150))
    base = " ".join(f"b{i}" for i in range(204))
    rows = [*((n, f"{own(n)} {cycle}") for n in range(4)), (10, base), (11, f"{base} {cycle}")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash_trie.keep_one_of_similar(table).collect()) == [0, 1, 2, 3, 10]


@pytest.mark.parametrize("pivots", [4, 1])
def test_boundary_pairs_of_any_length_are_found(spark, monkeypatch, pivots):
    """Planted pairs of similarity 0.80 to 0.86, from 8 words to 500; one word more makes one shingle more."""
    monkeypatch.setattr(simhash_trie._exact_links, "__defaults__", (pivots,))
    texts, pairs = [], []
    for n, (both, more) in enumerate([(4, 1), (6, 1), (12, 3), (40, 10), (180, 40), (400, 100)] * (20 if pivots == 4 else 5)):
        words = [f"v{n}w{i}" for i in range(both + more + 4)]
        texts += [(2 * n, " ".join(words[: both + 4])), (2 * n + 1, " ".join(words))]
        pairs.append(both / (both + more))
    assert min(pairs) == 0.8
    table = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash_trie.keep_one_of_similar(table).collect()) == list(range(0, 2 * len(pairs), 2))


def test_pairs_of_a_group_are_not_multiplied(spark, monkeypatch):
    """A chain of near copies that the tries leave open: the joins make a few rows a text, not a row a pair."""
    words = [f"c{i}" for i in range(600)]
    texts = [(n, " ".join(words[n : n + 40])) for n in range(300)]  # 36 shingles; neighbours share 35
    made = []
    plain = simhash_trie._similar

    def counted(pairs, *more):
        made.append(pairs.count())
        return plain(pairs, *more)

    monkeypatch.setattr(simhash_trie, "_similar", counted)
    table = spark.createDataFrame(texts, "doc_id long, text string")
    assert [r["doc_id"] for r in simhash_trie.keep_one_of_similar(table).collect()] == [0]
    assert sum(made) < 10 * len(texts) and not hasattr(simhash_trie, "_compare")


def _given(monkeypatch):
    """What the search for similar texts has its pairs compared by: a list of the numbers of pairs of its calls."""
    made, plain = [], simhash_trie._similar

    def counted(pairs, *more):
        made.append(pairs.count())
        return plain(pairs, *more)

    monkeypatch.setattr(simhash_trie, "_similar", counted)
    return made


def test_passages_of_a_few_long_texts_make_no_pairs(spark, monkeypatch):
    """Each passage is in nine texts, which are too long for the short sketches to tell apart."""
    made = _given(monkeypatch)
    say = lambda name, n: " ".join(f"{name}x{i}" for i in range(n))
    rows = [(9 * g + n, f"{say(f'g{g}n{n}', 600)} {say(f'p{g}', 60)}") for g in range(10) for n in range(9)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash_trie.keep_one_of_similar(table).count() == len(rows)
    assert sum(made) < len(rows)


def test_a_shingle_that_too_many_stand_before_makes_no_pairs(spark, monkeypatch):
    """Pairs that share four shingles, in texts of 800 and 690 words, where no shingle is known as common."""
    made = _given(monkeypatch)
    monkeypatch.setattr(simhash_trie, "COMMON", 1000)
    say = lambda name, n: " ".join(f"{name}x{i}" for i in range(n))
    rows = [(100 * g + n, f"{say(f'g{g}n{n}', 800 - 110 * n)} {say(f'p{g}', 8)}") for g in range(60) for n in range(2)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash_trie.keep_one_of_similar(table).count() == len(rows)
    assert sum(made) < 20  # of 60 pairs; in about 35 a shared shingle is in both prefixes, which are a fifth of the shingles


def test_pairs_meet_their_sketches_in_parts(spark, monkeypatch):
    """However many parts there are, the same pairs stay, and what the parts wrote is deleted."""
    words = [f"c{i}" for i in range(900)]
    texts = [(n, " ".join(words[n : n + 700])) for n in range(0, 200, 20)] + [(1000, " ".join(words[100:]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sets = {n: set(shingles.tolist()) for n, t in texts for shingles in [simhash_trie.shingle_hashes(t, 5)]}
    every = [(a, b) for a in sets for b in sets if a < b]
    truth = {(a, b) for a, b in every if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    sizes, plain = [], simhash_trie.written

    def seen(df, label):
        out = plain(df, label)
        if label == "simhash-maybe":
            sizes.append(out.count())
        return out

    pairs = plain(spark.createDataFrame(every, "a long, b long"), "pairs")
    monkeypatch.setattr(simhash_trie, "written", seen)
    found = []
    for moved in (1 << 30, 4096):
        monkeypatch.setattr(simhash_trie, "MOVED", moved)
        found.append({tuple(r) for r in simhash_trie._may_be_similar(pairs, docs, 0.8, 5).collect()})
    assert found[0] == found[1] and truth <= found[0] < set(every)
    assert len(sizes) > 10 and pairs.count() == len(every)


def test_short_sketches_are_folded_from_long_ones():
    own = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 3000, dtype=np.uint64))
    assert simhash_trie._folded(simhash_trie._parity(own, 8192), 1024) == simhash_trie._parity(own, 1024)


def test_a_written_table_leaves_no_shuffle_files(spark):
    def count():
        from pathlib import Path

        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return sum(1 for d in manager.localDirsString() for _ in Path(d).rglob("shuffle_*"))

    setting, before = spark.conf.get(durable.CLEANUP), count()
    table = durable.written(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("n")), "sums")
    until = time.time() + 20
    while count() > before and time.time() < until:
        time.sleep(0.1)
    assert count() <= before
    assert table.agg(F.sum("n")).first()[0] == 100_000 * 99_999 // 2 and spark.conf.get(durable.CLEANUP) == setting


def test_two_texts_under_one_id_are_both_judged(spark):
    say = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(1, say("a")), (5, say("a")), (5, say("b")), (5, say("c")), (7, say("c") + " more"), (7, say("d"))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = simhash_trie.keep_one_of_similar(table).collect()
    assert sorted(map(tuple, got)) == sorted([rows[0], rows[2], rows[3], rows[5]])


def _suffix_truth(texts, window):
    seen, out = set(), {}
    for d, t in texts:
        raw = _raw(t)
        gone = bytearray(len(raw))
        for p in range(len(raw) - window + 1):
            s = raw[p : p + window]
            if s in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(s)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("ranges", [100_000, 40])
def test_suffix_dedup_equals_brute_force(docs, empty, monkeypatch, ranges):
    monkeypatch.setattr(suffix_dedup, "RANGE_ENTRIES", ranges)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = suffix_dedup.dedup(docs).select(columns).collect()
    assert len(got) == len(TEXTS) + 1
    assert _by_id(got) == _suffix_truth([(3 * i, t) for i, t in enumerate(TEXTS)], 100)
    if ranges == 40:
        assert suffix_dedup.dedup(empty).count() == 0


def test_texts_without_repeats(docs):
    got = suffix_dedup.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[18]["text"] == "" and rows[18]["n_chars"] == 0 and rows[0]["text"] is None and rows[15]["text"] == TEXTS[5]


def test_loser_tree_merges_and_knows_prefixes():
    draw = random.Random(2)
    entries = sorted((bytes(draw.choices(b"ab", k=draw.randint(1, 9))), draw.randint(0, 50), i) for i in range(300))
    parts = [sorted(entries[i::7]) for i in range(7)]
    merged = list(suffix_dedup.loser_tree([suffix_dedup.front_decode(*suffix_dedup.front_code(p)) for p in parts]))
    assert [m[1:] for m in merged] == entries
    for before, (n, key, _, _) in zip(entries, merged[1:]):
        assert n == suffix_dedup.common_prefix(before[0], key)


def test_substring_dedup_equals_brute_force(docs, empty):
    words = {3 * i: _words(t) for i, t in enumerate(TEXTS)}
    count = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    want = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    got = substring_fm.dedup(docs).collect()
    assert len(got) == len(TEXTS) + 1 and _by_id(got) == want
    assert substring_fm.dedup(empty).count() == 0


def test_backward_search_counts():
    draw = random.Random(4)
    sequences = [np.array([draw.randint(0, 3) for _ in range(draw.randint(5, 40))], dtype=np.uint64) for _ in range(30)]
    window = 6
    count = Counter(tuple(s[i : i + window]) for s in sequences for i in range(len(s) - window + 1))
    want = {(n, i) for n, s in enumerate(sequences) for i in range(len(s) - window + 1) if count[tuple(s[i : i + window])] > 1}
    got = {(n, i) for n, s, e in substring_fm.repeated_intervals(sequences, window) for i in range(s, e - window + 1)}
    assert got == want


def test_edited_fingerprints(docs, empty):
    rows = fingerprints.edited_fingerprints(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    order = sorted([(3 * i, t or "") for i, t in enumerate(TEXTS)] + [(15, TEXTS[5])])
    want = Counter()
    for at, (d, t) in enumerate(order):
        after, n = order[(at + 1) % len(order)][1], len(t)
        want[d, n, hashlib.sha256((t[: n - n // 2] + after[: n // 2]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    by_text = {r["doc_id"]: r for r in rows}
    assert by_text[15]["fingerprint"] == by_text[18]["fingerprint"] and by_text[0]["fingerprint"] == "0" * 16
    for r in rows:
        bits = bin(int(r["fingerprint"], 16) ^ int(r["edited_fingerprint"], 16)).count("1")
        assert r["near_edited"] == 1 - bits / 64
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_next_documents_over_ranges(spark):
    ids = [-5, 0, 1023, 1024, 5000, 1 << 40, (1 << 62) + 3]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(rows, ["text"]).collect()}
    assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1])}


def test_block_tables_find_all_near_fingerprints(spark):
    draw = random.Random(8)
    centre = draw.getrandbits(64)
    values = sorted({centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4))) for _ in range(60)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in [*signed, signed[0], None]], "fingerprint long")
    got = {(r["a"], r["b"], r["bits"]) for r in fingerprints.near_fingerprints(prints).collect()}
    differ = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert got == {(a, b, differ(a, b)) for a in signed for b in signed if a < b and differ(a, b) <= 3}


def test_native_operators_have_no_python(docs):
    plan = fingerprints.near_fingerprints(docs.select(F.col("fingerprint")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
