"""Document fingerprints: SimHash by signed votes of weighted term hashes, and block tables to find near ones.

DataFrame functions only.  A term's 64-bit hash is spread over 32 longs: long ``j`` gets bits ``j`` and
``j + 32`` in its two halves, so 32 sums count the votes on all 64 bits at once.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loglattice.llm.common import successors, whole
from loglattice.plans.durable import written

BITS = 64
#: Documents in doc_id order that share a window; the bound of rows that meet in one group.
RANGE_BITS = 10
_LANES = (1 << 32) | 1
_HALF = (1 << 32) - 1


def term_weight(term: Column) -> Column:
    """Votes of one occurrence: short words, common in any text, count little; an empty term nothing."""
    n = F.length(term)
    return F.when(n == 0, 0).when(n <= 3, 1).otherwise(F.least(n, F.lit(9)) * 2 - 4).cast("long")


def _votes(term: Column) -> tuple[list[Column], Column]:
    h, w = F.xxhash64(term), F.col("__w")
    return [(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_LANES)) * w) for j in range(32)], w


def fingerprint(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key`` and the long ``fingerprint`` of the text of each row; ``key`` must be unique.

    A bit is 1 if the votes for it outweigh those against it.  Texts without terms have fingerprint 0.
    """
    terms = rows.select(*key, F.explode(F.split(F.col(text), "[ \t\n\r]+")).alias("__t")).withColumn("__w", term_weight(F.col("__t")))
    votes, weight = _votes(F.col("__t"))
    sums = terms.groupBy(*key).agg(*[F.sum(v).alias(f"__v{j}") for j, v in enumerate(votes)], F.sum(weight).alias("__all"))
    bits = F.lit(0).cast("long")
    for j in range(32):
        low = F.col(f"__v{j}").bitwiseAND(F.lit(_HALF))
        high = F.shiftrightunsigned(f"__v{j}", 32)
        for b, votes_for in ((j, low), (j + 32, high)):
            one = (1 << b) if b < 63 else -(1 << 63)
            bits = bits.bitwiseOR(F.when(votes_for * 2 > F.col("__all"), F.lit(one)).otherwise(F.lit(0)))
    return sums.select(*key, bits.alias("fingerprint"))


def hexadecimal(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def near_fingerprints(prints: DataFrame, radius: int = 3, fingerprint: str = "fingerprint", spare: int = 3) -> DataFrame:
    """All pairs (a, b, bits), a < b, of distinct fingerprints that differ in at most ``radius`` bits.

    The bits are cut into ``radius + spare`` blocks, and there is a table for each choice of ``spare``
    blocks: two fingerprints within the radius differ in at most ``radius`` blocks, so they agree on the
    blocks of at least one table.  A pair is taken from the first table on whose blocks it agrees, so
    none comes twice.  Nulls take no part; equal fingerprints are one.
    """
    n = radius + spare
    edges = [BITS * i // n for i in range(n + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(n)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = [signed(sum(masks[i] for i in c)) for c in combinations(range(n), spare)]
    one = prints.select(F.col(fingerprint).alias("f")).where("f is not null").distinct()
    keyed = one.select(
        "f", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).alias("m")) for t, m in enumerate(tables)])).alias("x")
    ).select("f", F.col("x.t").alias("t"), F.col("f").bitwiseAND(F.col("x.m")).alias("k"))
    a, b = keyed.withColumnRenamed("f", "a"), keyed.withColumnRenamed("f", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(tables)])
    pairs = a.join(b, ["t", "k"]).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius) & (first == F.col("t")))
    return pairs.select("a", "b", F.bit_count(differ).cast("int").alias("bits"))


def with_next(rows: DataFrame, columns: list[str], key: str = "doc_id", ties: str = "text") -> DataFrame:
    """``rows`` with ``next_<c>`` of the row that follows by ``key`` (rows of one key by ``ties``); the
    first follows the last.  Adds ``__range`` and ``__row``, which name a row.

    Ids are cut into ranges, in which windows run; the last row of a range takes its values from the
    first row of the next range that exists.  ``rows`` is read twice.
    """
    ranged = rows.withColumn("__range", F.shiftright(F.coalesce(F.col(key), F.lit(-1)), RANGE_BITS))
    order = Window.partitionBy("__range").orderBy(key, ties)
    inside = ranged.withColumn("__row", F.row_number().over(order))
    for c in columns:
        inside = inside.withColumn(f"__lead_{c}", F.lead(F.struct(c)).over(order))

    heads = ranged.groupBy("__range").agg(F.min(F.coalesce(F.col(key), F.lit(-(1 << 62)))).alias("__id"))
    first = ranged.withColumn("__id", F.coalesce(F.col(key), F.lit(-(1 << 62)))).join(heads, ["__range", "__id"])
    lowest = Window.partitionBy("__range").orderBy(ties)
    first = first.withColumn("__n", F.row_number().over(lowest)).where("__n = 1")
    first = first.select(F.col("__range").alias("__after"), F.struct(*columns).alias("__first"))
    around = heads.agg(F.min("__range")).first()[0]
    links = successors(heads, "__range", "__after").withColumn("__after", F.coalesce("__after", F.lit(around)))
    edges = links.join(first, "__after").select("__range", "__first")
    joined = inside.join(edges, "__range", "left")
    for c in columns:
        joined = joined.withColumn(f"next_{c}", F.coalesce(F.col(f"__lead_{c}"), F.struct(F.col(f"__first.{c}").alias(c)))[c])
    return joined.drop("__first", *[f"__lead_{c}" for c in columns])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text of ``docs`` (doc_id, text) and of its edited text.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the
    next document's text, by doc_id; after the last comes the first.  Null texts are empty and have
    fingerprint 0; rows that repeat a doc_id follow each other by text, and a null doc_id comes first.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(text, cast(length(text) - length(text) div 2 as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(texts, ["text"]).select("__range", "__row", "doc_id", n.alias("n_chars"), "text", edited.alias("edited"))
    both = F.explode(F.array(F.struct(F.lit(False).alias("e"), F.col("text").alias("t")), F.struct(F.lit(True).alias("e"), F.col("edited").alias("t"))))
    key = ["__range", "__row", "doc_id", "n_chars", "__edited_sha", "__is"]
    spread = rows.withColumn("__edited_sha", F.unhex(F.sha2(F.col("edited"), 256))).select(*key[:-1], both.alias("x"))
    spread = spread.select(*key[:-1], F.col("x.e").alias("__is"), F.col("x.t").alias("__text"))
    prints = fingerprint(spread, key, "__text")
    pair = prints.groupBy(*key[:-1]).agg(
        F.max(F.when(~F.col("__is"), F.col("fingerprint"))).alias("__f"), F.max(F.when(F.col("__is"), F.col("fingerprint"))).alias("__e")
    )
    narrow = written(pair, "fingerprints")
    after = with_next(narrow.withColumnRenamed("__range", "__r0").withColumnRenamed("__row", "__place"), ["__f"], ties="__place")
    return after.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("__edited_sha")).alias("edited_sha256"),
        hexadecimal(F.col("__f")).alias("fingerprint"),
        hexadecimal(F.col("__e")).alias("edited_fingerprint"),
        likeness(F.col("__f"), F.col("__e")).alias("near_edited"),
        likeness(F.col("__f"), F.col("next___f")).alias("near_next"),
    )
