"""Documents to packed training sequences: quality, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm import packing, quality, simhash_trie, suffix_dedup
from loglattice.llm.common import table
from loglattice.llm.queries import tokenizer_file
from loglattice.plans.durable import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.7."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of equal or similar texts (5-word shingles, 0.8)."""
    return simhash_trie.keep_one_of_similar(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that also start earlier."""
    return suffix_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: sequence_id, ids, doc_ids, lengths, padding."""
    return packing.pack_sequences(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("near_dedup", one_of_similar), ("suffix_dedup", no_repeats), ("packing", packed)]

#: No SQL expresses the learned scores, the similarity search or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the written rows of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
