"""Operator 8 - URL filters: rules first, then link-graph propagation per host.

A rule is ``host/path``; it fits its host and all subdomains where the URL's path starts with the
rule's path, and the longest rule that fits decides.  Pages without a rule are judged by their host:
pages that rules allow are the seeds of a personalised PageRank over the links between hosts, pages
that rules block those of a PageRank over the reversed links (who links to bad hosts is suspect).  A
seed's mass is its share of all seed pages of its kind, so that the larger set of seeds has no
advantage.  A host is blocked when distrust exceeds trust by ``margin``.

Links are the absolute targets of href and src attributes, between different hosts.  Each round of
the iteration is written to the shared folder; it ends, after however many rounds, when no host is new
and no host's own mass changes by more than ``tolerance`` of itself, so unrelated hosts have no say.

The rule list is a parameter that goes into the plan, so it must be of moderate size.

Defined cases: URLs and pages of any length are read whole; a null URL or one without ``://`` has an empty host and path and no rule; such pages
and hosts that no mass reaches are allowed; null html has no links; repeated rows are pages of their
own; a null page_id stays null; an empty table gives an empty result; further columns are ignored.
Everything is DataFrame operations.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .scratch import Scratch

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING, TOLERANCE, MARGIN = 0.85, 1e-6, 0.0
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring({url}, locate('://', {url}) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules=RULES) -> Column:
    """The longest rule that fits columns ``host`` and ``path``, as a struct (rule, verdict), or null."""
    result = F.lit(None).cast("struct<rule:string,verdict:string>")
    chain = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        named = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, named) if chain is None else chain.when(fits, named)
    return result if chain is None else chain.otherwise(result)


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): how often pages of one host link to another host."""
    host, _ = host_and_path(url)
    found = F.explode(F.regexp_extract_all(F.col(html), F.lit(_LINK), F.lit(1)))
    return (pages.where(F.col(html).isNotNull()).select(host.alias("src"), found.alias("dst"))
            .withColumn("dst", F.translate("dst", _UPPER, _LOWER)).where("src <> '' AND src <> dst")
            .groupBy("src", "dst").agg(F.count("*").alias("n")))


def propagate(scratch: Scratch, links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust): personalised PageRank of ``seeds`` (host, trust, distrust) both ways."""
    both = (links.select(F.lit("trust").alias("way"), "src", "dst", "n")
            .unionByName(links.select(F.lit("distrust").alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")))
    out = both.groupBy("way", "src").agg(F.sum("n").alias("out"))
    edges = scratch.save(both.join(out, ["way", "src"]).select("way", "src", "dst", (F.col("n") / F.col("out")).alias("w")), "edges")
    start = scratch.save(seeds.select(F.lit("trust").alias("way"), "host", F.col("trust").cast("double").alias("mass"))
                         .unionByName(seeds.select(F.lit("distrust").alias("way"), "host", F.col("distrust").cast("double").alias("mass"))).where("mass > 0"), "start")
    rank = start.withColumn("mass", F.col("mass") * (1 - damping))
    # Masses only grow, and the largest relative change never does: a host that is reached anew has changed by 1.
    for k in count():
        moved = rank.join(edges, (rank["way"] == edges["way"]) & (rank["host"] == edges["src"])).select(
            rank["way"], F.col("dst").alias("host"), (F.col("mass") * F.col("w") * damping).alias("mass"))
        parts = start.select("way", "host", (F.col("mass") * (1 - damping)).alias("new"), F.lit(0.0).alias("old"))
        parts = parts.unionByName(moved.select("way", "host", F.col("mass").alias("new"), F.lit(0.0).alias("old")))
        parts = parts.unionByName(rank.select("way", "host", F.lit(0.0).alias("new"), F.col("mass").alias("old")))
        following = scratch.save(parts.groupBy("way", "host").agg(F.sum("new").alias("mass"), F.sum("old").alias("old")), f"rank-{k}", release=False)
        change = following.where("mass > 0").agg(F.max(F.abs(F.col("mass") - F.col("old")) / F.col("mass"))).first()[0] or 0.0
        rank = following.select("way", "host", "mass")
        if k:
            scratch.drop(f"rank-{k - 1}")
        if change <= tolerance:
            break
    return rank.groupBy("host").agg(F.sum(F.when(F.col("way") == "trust", F.col("mass")).otherwise(0.0)).alias("trust"),
                                    F.sum(F.when(F.col("way") == "distrust", F.col("mass")).otherwise(0.0)).alias("distrust"))


def judge_urls(spark: SparkSession, pages: DataFrame, rules=RULES, margin: float = MARGIN) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of ``pages``."""
    scratch = Scratch(spark, "url-filter")
    host, path = host_and_path("url")
    placed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("fit", rule_of(rules))
    seeds = placed.where("host <> ''").groupBy("host").agg(F.count_if(F.col("fit.verdict") == "allow").alias("trust"),
                                                           F.count_if(F.col("fit.verdict") == "block").alias("distrust"))
    seeds = scratch.save(seeds, "seeds")
    trust, distrust = (F.lit(float(n or 1)) for n in seeds.agg(F.sum("trust"), F.sum("distrust")).first())
    mass = propagate(scratch, host_links(pages), seeds.select("host", (F.col("trust") / trust).alias("trust"), (F.col("distrust") / distrust).alias("distrust")))
    verdicts = mass.select("host", F.when(F.col("distrust") - F.col("trust") > margin, "block").otherwise("allow").alias("by_links"))
    return (placed.join(verdicts, "host", "left")
            .select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "by_links", F.lit("allow")).alias("verdict")))
