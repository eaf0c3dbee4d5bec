"""URL filters: host and path rules, and for other pages a verdict from trust and distrust spread over host links.

Rules: a rule names a host with all its subdomains, and how a path must start; the longest rule that fits wins. The rule
table is small and given by the caller, so it becomes one literal expression: no join.

Link graph: hosts are nodes; an absolute hyperlink of a page from one host to another is an edge. Trust is personalised
PageRank along links from the hosts whose pages rules allow, distrust the same against links from those whose pages rules
block (who links to blocked hosts is suspect); the seed of a host is that share of its pages. A mass by itself falls with the
number of hosts that share it and with the size of the graph. So it is held against PageRank from all hosts alike over
the same links: what a host receives from seeds, as a part of what it receives at all, is a share from 0 to 1 that
depends on where its links lead only. A host's trust or distrust is seed + (1 - seed) * that share. A page that no rule fits is blocked
if its host's distrust is at least BLOCK_AT and above its trust, else allowed.

All four masses move in one pass a round: a join and an aggregation by host over aggregated host edges, written to the shared
folder. A host with a third of all pages or links is aggregated map-side first, and rounds work on two rows for each pair of hosts.
Verdicts of hosts and the state of a round are broadcast where they are counted to be few, so that a common host is no hot
key; beyond, Spark splits joins that are skewed. Hosts without links send nothing on; without edges there are no rounds.

Cases: a null url, or one without "://", has empty host and path, fits no rule, is no node, and is allowed; null or empty
html has no links; very long html is searched whole; repeated pages count each time; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, if_small, written

DAMPING, ROUNDS, BLOCK_AT, EQUAL = 0.85, 12, 0.5, 1e-9
#: Fixed values: (host, path, verdict) of the contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null. Of equally long ones the first as a string wins."""
    found = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        named = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, named) if found is None else found.when(fits, named)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, rule_verdict of each page."""
    named = pages.select(pages["page_id"], host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    hit = named.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    return hit.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("rule_verdict"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): absolute hyperlinks between different hosts."""
    quoted = F.regexp_extract_all(pages["html"], F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?((?:https?:)?//[^\"'\s>]*)"), F.lit(1))
    links = pages.select(host_of(pages["url"]).alias("src"), F.explode(quoted).alias("link"))
    links = links.select("src", host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))).alias("dst"))
    return links.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def seeds(pages_judged: DataFrame) -> DataFrame:
    """(host, trust, distrust): shares of a host's pages that rules allow and block."""
    return (
        pages_judged.filter("host <> ''")
        .groupBy("host")
        .agg(
            F.avg(F.coalesce((F.col("rule_verdict") == "allow").cast("double"), F.lit(0.0))).alias("trust"),
            F.avg(F.coalesce((F.col("rule_verdict") == "block").cast("double"), F.lit(0.0))).alias("distrust"),
        )
    )


def flows(edges: DataFrame) -> DataFrame:
    """(node, other, forth, back): the part of other's links that lead to node, and the part of the links to other that come from node."""
    both = edges.join(edges.groupBy("src").agg(F.sum("links").alias("sent")), "src").join(edges.groupBy("dst").agg(F.sum("links").alias("met")), "dst")
    nothing = F.lit(0.0)
    forth = both.select(F.col("dst").alias("node"), F.col("src").alias("other"), (F.col("links") / F.col("sent")).alias("forth"), nothing.alias("back"))
    back = both.select(F.col("src").alias("node"), F.col("dst").alias("other"), nothing.alias("forth"), (F.col("links") / F.col("met")).alias("back"))
    return forth.unionByName(back)


def propagate(seed: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(node, trust_seed, distrust_seed, and for each of trust, all_forth, distrust, all_back the mass received in the last round).

    seed: (host, trust, distrust); edges: (src, dst, links). A node has (1 - damping) of its seed (of 1 for all_forth and all_back)
    and what it receives: damping times the masses of its neighbours, each by the part of their links.
    """
    found = written(flows(written(edges, "edges")), "flows")
    nodes = found.select("node").distinct().join(seed.select(F.col("host").alias("node"), F.col("trust").alias("trust_seed"), F.col("distrust").alias("distrust_seed")), "node", "full_outer")
    kinds = {"trust": ("forth", F.col("trust_seed")), "all_forth": ("forth", F.lit(1.0)), "distrust": ("back", F.col("distrust_seed")), "all_back": ("back", F.lit(1.0))}
    state = written(nodes.na.fill(0.0).select("*", *(F.lit(0.0).alias(k) for k in kinds)), "rank")
    if found.isEmpty():
        return state
    light = F.broadcast if state.count() <= BROADCAST_ROWS else (lambda df: df)
    for _ in range(rounds):
        masses = light(state.select(F.col("node").alias("other"), *(((1 - damping) * s + F.col(k)).alias(k) for k, (_, s) in kinds.items())))
        got = found.join(masses, "other").groupBy("node").agg(*(F.sum(damping * F.col(k) * F.col(by)).alias(k) for k, (by, _) in kinds.items()))
        still = state.select("node", "trust_seed", "distrust_seed").join(light(got), "node", "left")
        state = written(still.na.fill(0.0), "rank")
    return state


def host_verdicts(pages_judged: DataFrame, edges: DataFrame, rounds: int = ROUNDS, block_at: float = BLOCK_AT) -> DataFrame:
    """(host, trust, distrust, verdict) of each host that has a page or a link, by relative PageRank masses."""

    def relative(kind: str, of: str) -> Column:
        share = F.when(F.col(of) > 0, F.col(kind) / F.col(of)).otherwise(0.0)
        return F.col(f"{kind}_seed") + (1 - F.col(f"{kind}_seed")) * share

    spread = propagate(seeds(pages_judged), edges, rounds).select(F.col("node").alias("host"), relative("trust", "all_forth").alias("trust"), relative("distrust", "all_back").alias("distrust"))
    # sums of doubles depend on their order; what is equal but for that counts as equal
    blocked = (F.col("distrust") >= block_at - EQUAL) & (F.col("distrust") > F.col("trust") + EQUAL)
    return spread.withColumn("verdict", F.when(blocked, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, rounds: int = ROUNDS, block_at: float = BLOCK_AT) -> DataFrame:
    """page_id, host, path, rule, verdict of each page."""
    own = judged(pages, rules)
    hosts = host_verdicts(own, host_edges(pages), rounds, block_at).select(F.col("host").alias("of"), F.col("verdict").alias("host_verdict"))
    both = own.join(if_small(written(hosts, "verdicts")), own["host"] == F.col("of"), "left")
    return both.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"))
