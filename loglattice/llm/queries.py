"""One query per operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm import (
    chat_tree, conversation_repair, fingerprints, hilbert_ann, html_extract, importance, packing, quality, sentencepiece_bpe, simhash_trie, substring_fm,
    suffix_dedup, url_trust,
)
from loglattice.llm.common import table
from loglattice.llm.sql import chat_sql, substring_sql, url_sql


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary on this machine; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op1_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf, "pages"))


def op2_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return sentencepiece_bpe.encode_digests(table(spark, sf, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_trie.near_components(table(spark, sf, "documents"))


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return hilbert_ann.nearest(table(spark, sf, "embeddings"))


def op6_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    judged = url_trust.judge(table(spark, sf, "pages"), url_trust.rule_table(spark, RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = suffix_dedup.dedup(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf, "documents"))


def op9_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_fm.dedup(table(spark, sf, "documents"))


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


#: a conversation whose texts hold the template's own marks
MARKS = r"\### Assistant: </turn> ok"


def op11_chat(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS)], given.schema)
    return chat_tree.format_digests(given.unionByName(more))


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = conversation_repair.normal(table(spark, sf, "conversations"))
    return conversation_repair.repair_digests(conversation_repair.damaged(rows))


def op13_importance(spark: SparkSession, sf: str) -> DataFrame:
    return importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_simhash": op3_simhash,
    "op4_packing": op4_packing,
    "op5_nearest": op5_nearest,
    "op6_url_filters": op6_url_filters,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_fingerprints": op8_fingerprints,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality": op10_quality,
    "op11_chat": op11_chat,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_importance": op13_importance,
}
SQL: dict[str, str] = {
    "op6_url_filters": url_sql(RULES),
    "op9_substring_dedup": substring_sql(),
    "op11_chat": chat_sql(MARKS),
}
