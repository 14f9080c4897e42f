"""URL filters: rules by host and path, and trust spread over the link graph for what no rule names.

DataFrame functions only.  Pages that rules allow seed trust, which follows links (personalised
PageRank); pages that rules block seed distrust, which follows links backwards.  A host whose distrust
outweighs its trust is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm.common import ascii_lower, whole
from loglattice.plans.durable import written

LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([a-z][a-z0-9+.-]*://[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rules given as (verdict, host with path) as columns rule, verdict, rule_host, rule_path."""
    rows = [(r, v, r.split("/", 1)[0].lower(), "/" + r.split("/", 1)[1] if "/" in r else "") for v, r in rules]
    return spark.createDataFrame(rows, "rule string, verdict string, rule_host string, rule_path string")


def suffixes(host: Column) -> Column:
    """The host and each domain above it: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct ``host`` the rules of it and of the domains above it, longest first."""
    named = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("rule_host"))
    found = named.join(rules, "rule_host")
    size = F.length(F.col("rule_host")) + F.length(F.col("rule_path"))
    item = F.struct(size.alias("size"), F.col("rule"), F.col("rule_path").alias("path"), F.col("verdict"))
    return found.groupBy("host").agg(F.sort_array(F.collect_set(item), asc=False).alias("rules"))


def longest(path: Column, rules: Column) -> Column:
    """The longest of a host's rules whose path the page's path starts with; null if none does."""
    return F.get(F.filter(rules, lambda r: F.startswith(path, r["path"])), F.lit(0))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between hosts, and between a host and the domain above it, which it belongs to.

    ``pages`` has host and html.  Links of a page to its own host say nothing here and are left out.
    """
    links = pages.select("host", F.explode(F.regexp_extract_all(whole("html"), F.lit(LINK), F.lit(1))).alias("__url"))
    out = links.select(F.col("host").alias("src"), host_of(F.col("__url")).alias("dst"))
    out = out.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    names = pages.select("host").where("host <> ''").distinct()
    chain = names.select(F.explode(suffixes(F.col("host"))).alias("h")).distinct().where(F.instr("h", ".") > 0)
    up = chain.select(F.col("h").alias("src"), F.expr("substring(h, instr(h, '.') + 1)").alias("dst")).where(F.instr("dst", ".") > 0)
    both = up.union(up.select("dst", "src"))
    return out.union(both.withColumn("n", F.lit(1))).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 12) -> DataFrame:
    """(kind, host, rank) after ``rounds`` of personalised PageRank on both kinds of seeds at once.

    ``seeds`` has host, trust, distrust (not negative).  Trust walks along edges, distrust against them;
    what a host without outgoing edges holds is not passed on.  Each kind's seeds are scaled to sum 1.
    """
    sums = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    kinds = F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), (F.col("trust") / F.lit(float(sums["t"] or 1))).alias("seed")),
        F.struct(F.lit("distrust").alias("kind"), (F.col("distrust") / F.lit(float(sums["d"] or 1))).alias("seed")),
    ))
    base = seeds.select("host", kinds.alias("x")).where("x.seed > 0").select("x.kind", "host", "x.seed")
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n"))
    total = ways.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    ways = written(ways.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("w")), "url-edges")
    base = written(base, "url-seeds")
    start = base.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))
    rank = start
    for i in range(1, rounds + 1):
        moved = rank.withColumnRenamed("host", "src").join(ways, ["kind", "src"])
        moved = moved.select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("w") * damping).alias("rank"))
        rank = moved.union(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if i % 4 == 0:
            rank = written(rank, "url-rank")
    return rank


def judge(pages: DataFrame, rules: DataFrame, ratio: float = 2.0, damping: float = 0.85, rounds: int = 12) -> DataFrame:
    """Every page as page_id, host, path, rule, verdict, trust, distrust.

    ``pages`` has page_id, url, html; other columns do not matter.  A rule's verdict stands.  Else the
    host is blocked if its distrust is over ``ratio`` times its trust (both in units of seeding pages);
    a host that neither reaches, an empty one included, is allowed.  Null urls have an empty host and
    path.  Repeated rows and repeated ids stay.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    hosts = named.groupBy("host").agg(F.count("*").alias("pages"))
    fitting = host_rules(hosts, rules)
    ruled = named.drop("html").join(fitting, "host", "left").withColumn("r", longest(F.col("path"), F.col("rules"))).drop("rules")
    tally = lambda v: F.sum(F.when(F.col("r.verdict") == v, 1).otherwise(0))
    seeds = written(ruled.groupBy("host").agg(tally("allow").alias("trust"), tally("block").alias("distrust")), "url-tally")
    sums = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    edges = written(host_edges(named), "url-links")
    ranks = spread(seeds, edges, damping, rounds)
    by_kind = lambda k, total: F.sum(F.when(F.col("kind") == k, F.col("rank") * float(total or 0)).otherwise(0.0)).alias(k)
    held = ranks.groupBy("host").agg(by_kind("trust", sums["t"]), by_kind("distrust", sums["d"]))
    known = hosts.select("host").join(fitting, "host", "left").join(held, "host", "left")
    method = F.when(F.col("distrust") > F.col("trust") * ratio, "block").otherwise("allow")
    out = named.drop("html").join(written(known, "url-hosts"), "host", "left").withColumn("r", longest(F.col("path"), F.col("rules")))
    return out.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), method).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
