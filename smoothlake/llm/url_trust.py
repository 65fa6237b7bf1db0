"""URL filter: host and path rules first, link-graph propagation for what no rule covers.

Hosts are vertices; an edge is a page of one host that links to another, weighted by the number of such
links. Trust is personalised PageRank from the hosts with pages that a rule allows, each weighted by their
number; distrust runs along the reversed edges from the hosts with pages that a rule blocks. Both run until
what still moves is below a tolerance, however long the way from a seed. A host is blocked where its distrust exceeds
``threshold`` times the sum of both. All of it is joins and sums over host tables; per round one table is
written to the shared folder, and nothing but the table names reaches the driver.

Edge cases: a null url, or one without ``://``, has an empty host and path, no rule and the default verdict;
null or empty html has no links; a host without links, or without any rank, gets the default verdict;
very long urls and pages are read whole; where distrust exactly equals the threshold's share the host is allowed;
repeated rows are judged row by row, and their links count as often; an empty table gives an empty table; extra
columns, also of the result's names, are ignored. Rank that reaches a host without links ends there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import staged

#: Fixed values of the contract: host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


@dataclass(frozen=True)
class TrustOptions:
    """rules; damping of the propagation; tolerance: sum of what its ranks may still gain at the end (the seeds'
    weights sum to one); threshold: share of distrust that blocks a host; default: verdict of a host without any rank."""

    rules: tuple[tuple[str, str, str], ...] = RULES
    damping: float = 0.85
    tolerance: float = 1e-13
    threshold: float = 0.5
    default: str = "allow"

    @property
    def rounds(self) -> int:
        """Rounds after which the tolerance is met on any graph: a round leaves at most ``damping`` of what moves."""
        return max(1, math.ceil(math.log(self.tolerance) / math.log(self.damping)))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``, or an empty string."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _flow(edges: DataFrame, seeds: DataFrame, o: TrustOptions, name: str) -> DataFrame:
    """(host, rank): personalised PageRank along (src, dst, share) from (host, n) seeds, weighted by n.

    What a host without outgoing edges holds is not passed on; ranks are compared, not summed to one.
    """
    total = seeds.agg(F.sum("n")).first()[0] or 1
    start = staged(seeds.select("host", (F.col("n") / F.lit(float(total))).alias("seed")), name)
    kept = start.select("host", (F.lit(1 - o.damping) * F.col("seed")).alias("rank"))
    # from these ranks on no rank falls, so that the gain of four rounds bounds all that is still to come
    rank, before, left = kept, 0.0, o.damping**4 / (1 - o.damping**4)
    for i in range(o.rounds):
        moved = edges.join(rank, edges.src == rank.host).select(F.col("dst").alias("host"), (F.lit(o.damping) * F.col("rank") * F.col("share")).alias("rank"))
        rank = moved.unionByName(kept).groupBy("host").agg(F.sum("rank").alias("rank"))
        if i % 4 == 3 or i == o.rounds - 1:
            rank = staged(rank, name)
            now = rank.agg(F.sum("rank")).first()[0] or 0.0
            if (now - before) * left <= o.tolerance:
                break
            before = now
    return rank


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    url = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)(?:href|src)\s*=\s*["']?([a-z][a-z0-9+.\-]*://[^"'\s>]*)"""), F.lit(1))
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(url).alias("link"))
    return found.select("src", host_of(F.col("link")).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_scores(pages: DataFrame, options: TrustOptions = TrustOptions()) -> DataFrame:
    """(host, trust, distrust, blocked) of every host that has a rank."""
    o = options
    edges = staged(links(pages), "links")
    hosts = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    _, verdict = rule_of(F.col("host"), F.col("path"), o.rules)
    ruled = hosts.withColumn("verdict", verdict).where("host <> '' AND verdict IS NOT NULL")
    marked = staged(ruled.groupBy("host", "verdict").agg(F.count("*").alias("n")), "seeds")

    def shares(a: str, b: str) -> DataFrame:
        out = edges.groupBy(F.col(a).alias("whole")).agg(F.sum("n").alias("total"))
        return staged(edges.join(out, F.col(a) == F.col("whole")).select(F.col(a).alias("src"), F.col(b).alias("dst"), (F.col("n") / F.col("total")).alias("share")), "shares")

    trust = _flow(shares("src", "dst"), marked.where("verdict = 'allow'"), o, "trust")
    distrust = _flow(shares("dst", "src"), marked.where("verdict = 'block'"), o, "distrust")
    both = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full")
    both = both.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    return both.withColumn("blocked", F.col("distrust") > F.lit(o.threshold) * (F.col("trust") + F.col("distrust")))


def judge(pages: DataFrame, options: TrustOptions = TrustOptions()) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: one row per page."""
    o = options
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), o.rules)
    scores = staged(host_scores(pages, o).withColumnRenamed("host", "scored"), "scores")
    # a page needs its host's row of a table with one row per host; adaptive execution splits a hot host's pages
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).join(scores, F.col("host") == F.col("scored"), "left")
    own = F.when(F.col("blocked"), "block").when(~F.col("blocked"), "allow").otherwise(o.default)
    return rows.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", rule.alias("rule"), F.coalesce(ruled, own).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
