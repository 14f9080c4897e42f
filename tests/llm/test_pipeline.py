"""The pipeline's stages, each held against brute force on its own input."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from loglattice.llm.packing import word_ids
from loglattice.llm.queries import tokenizer_file
from loglattice.llm.simhash_trie import shingle_hashes
from test_pairs_and_text import _suffix_truth

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The input and each stage's rows, written and read again."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns_of_documents(steps):
    assert all(df.columns == steps[0].columns for df in steps[1:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "suffix_dedup", "packing"]


def test_quality_keeps_the_good(spark, steps):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in steps[1].collect()}
    said = [(y, d in kept) for d, y in labels.items()]
    assert sum(bool(y) == k for y, k in said) / len(said) > 0.95


def test_one_of_each_group_of_similar_texts_stays(steps):
    sets = {r["doc_id"]: frozenset(shingle_hashes(r["text"] or "", 5).tolist()) for r in steps[1].collect()}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = min(root[a], root[b]), max(root[a], root[b])
                root = {d: x if r == y else r for d, r in root.items()}
    assert {r["doc_id"] for r in steps[2].collect()} == set(root.values())


def test_repeated_bytes_go(steps):
    before = sorted((r["doc_id"], r["text"]) for r in steps[2].collect())
    truth = _suffix_truth(before, 100)
    texts = dict(before)
    for r in steps[3].collect():
        n, gone, _, digest = truth[r["doc_id"]]
        if gone == 0:
            assert r["text"] == texts[r["doc_id"]]
        elif len((r["text"] or "").encode()) == n - gone:  # no code point was cut in two
            assert hashlib.sha256(r["text"].encode()).hexdigest() == digest
        else:
            assert n - gone - 6 * truth[r["doc_id"]][2] <= len(r["text"].encode()) < n - gone
        assert r["n_chars"] == len(r["text"] or "")


def test_every_token_is_packed_once(steps):
    encoder = word_ids(tokenizer_file("word_bpe_49k.json"))
    want = Counter({r["doc_id"]: len(next(encoder.encode([r["text"] or ""]))) // 4 + 1 for r in steps[3].collect()})
    got = Counter()
    for r in steps[4].collect():
        assert len(r["ids"]) == sum(r["lengths"]) <= 2048
        for d, n in zip(r["doc_ids"], r["lengths"]):
            got[d] += n
    assert got == want
