"""URL filters: rules first, then trust and distrust spread over the links between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnframe.llm.common import materialize

#: (host, path, verdict), as the contract states them.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DAMPING = 0.85
#: A host has converged when a round changes its rank by no more than this share of it; so a host that is newly reached has not.
TOLERANCE = 1e-6
#: Only a guard: after so many links the rank of a host is below what a double can hold.
MOST_ROUNDS = 5000
#: A host is blocked where the distrust that reaches it exceeds the trust by this factor.
MARGIN = 1.0
LINK = r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, lower-cased in A-Z only; empty without ://."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    return F.coalesce(*fits)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): of each host's links to other hosts, the share that goes to each."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    pairs = found.select("src", host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))).alias("dst"))
    return pairs.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(spark: SparkSession, edges: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """Personalised PageRank: (host, rank) from edges (src, dst, links) and seeds (host, rank), whose ranks sum to 1.

    Without a number of rounds it goes on until all hosts have converged, those reached last and with little rank too.
    Per round one join and one sum by host; a hub's in-links are summed before they are shuffled, and the skewed side of
    the join is split by adaptive execution. Rank on hosts without out-links is dropped, as for any substochastic walk.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("total"))
    shares = materialize(spark, edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("total")).alias("share")), "edges")
    rank = materialize(spark, seeds, "rank")
    base = rank.select("host", ((1 - DAMPING) * F.col("rank")).alias("rank"))
    for _ in range(MOST_ROUNDS if rounds is None else rounds):
        flow = rank.join(shares, rank["host"] == shares["src"]).select(F.col("dst").alias("host"), (DAMPING * F.col("rank") * F.col("share")).alias("rank"))
        parts = base.union(flow).withColumn("old", F.lit(0.0)).union(rank.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("old")))
        both = materialize(spark, parts.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old")).where("rank > 0"), "rank")
        rank = both.select("host", "rank")
        if rounds is None and both.where(F.abs(F.col("rank") - F.col("old")) > TOLERANCE * F.col("rank")).isEmpty():
            return rank
    if rounds is None:
        raise RuntimeError(f"the ranks of hosts have not converged in {MOST_ROUNDS} rounds")
    return rank


def host_verdicts(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(host, trust, distrust) of every host that a seed reaches. Trust starts from hosts of pages that a rule allows and
    follows links; distrust starts from hosts of pages that a rule blocks and follows links backwards. A host's seed is
    the share of its ruled pages."""
    ruled = pages.select(host_of(F.col("url")).alias("host"), matched_rule(host_of(F.col("url")), path_of(F.col("url")))["verdict"].alias("v")).where("v is not null")
    counts = materialize(spark, ruled.groupBy("host").agg(F.avg((F.col("v") == "allow").cast("double")).alias("allow"), F.avg((F.col("v") == "block").cast("double")).alias("block")), "seeds")
    edges = materialize(spark, host_edges(pages), "links")
    total = counts.agg(F.sum("allow").alias("a"), F.sum("block").alias("b")).first()
    allow = counts.where("allow > 0").select("host", (F.col("allow") / F.lit(total["a"] or 1.0)).alias("rank"))
    block = counts.where("block > 0").select("host", (F.col("block") / F.lit(total["b"] or 1.0)).alias("rank"))
    if edges.isEmpty():
        trust, distrust = allow, block
    else:
        trust = propagate(spark, edges, allow)
        distrust = propagate(spark, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links"), block)
    return trust.select("host", F.col("rank").alias("trust")).join(distrust.select("host", F.col("rank").alias("distrust")), "host", "full_outer").na.fill(0.0, ["trust", "distrust"])


def url_filter(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Host, path, rule and verdict of every page.

    A null url, or one without ://, has empty host and path and is allowed: nothing speaks against it. A null html has no
    links. Hosts that neither trust nor distrust reaches are allowed. Repeated rows are judged alike; no rows give no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", matched_rule(F.col("host"), F.col("path")))
    by_host = host_verdicts(spark, pages).select("host", "trust", "distrust")
    spread = F.when(F.col("distrust") > MARGIN * F.col("trust"), "block").otherwise("allow")
    return judged.join(by_host, "host", "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", spread).alias("verdict"), "trust", "distrust")
