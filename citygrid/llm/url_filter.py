"""Allow and block verdicts for page urls: rules first, then trust over the links between hosts.

A page's url gives a host and a path; the longest rule that fits them decides. Pages
that no rule fits are judged by their host: trust starts at hosts with allowed pages
and follows links, distrust starts at hosts with blocked pages and goes against the
links (who links to blocked hosts is distrusted). Both are personalised PageRank in
whole numbers, so sums do not depend on the order of rows. A host is blocked when its
distrust exceeds its trust by a threshold.

Links within one host say nothing about others and are left out. The rounds run over
hosts and pairs of hosts, never over pages; each sums all that a host gets, with the
sums begun before the shuffle, so a host that many link to is no hot key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citygrid.lineage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict); a rule is a host, "/" and the rest of a path.
Rules = list[tuple[str, str]]


@dataclass(frozen=True)
class Settings:
    rounds: int = 20
    damping: int = 85  # percent of a host's trust that its links pass on
    unit: int = 1_000_000_000  # a host all of whose pages are allowed starts with it
    margin: int = 75_000_000  # blocked: distrust - trust is at least this, half of what a wholly blocked host keeps
    most_rules: int = 10_000  # rules are a parameter, not a table


def host_of(url: str | Column) -> Column:
    """What stands between the first :// and the next / ? # or the end; null and others: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: Rules, host: Column, path: Column) -> Column:
    """The longest rule that fits, else null: its host is ``host`` or an end of it after a
    dot, its path is how ``path`` begins. Of equally long rules the first in order counts."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        at, begin = rule.split("/", 1)
        found = F.when(((host == at) | host.endswith("." + at)) & path.startswith("/" + begin), F.lit(rule)).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """pages (url, html) -> source, target, n: links between different hosts, with their number.

    Links are href attributes of ``a`` elements outside comments, scripts and styles
    that name a host (``https://..`` or ``//..``); all others stay in their host.
    """
    shown = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    href = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*((?:https?:)?//[^/?#"'\s>]+)"""
    named = pages.select(host_of("url").alias("source"), F.explode(F.regexp_extract_all(shown, F.lit(href), 1)).alias("link"))
    named = named.select("source", F.translate(F.regexp_extract("link", "//(.*)$", 1), UPPER, LOWER).alias("target"))
    return named.filter("source <> target AND source <> '' AND target <> ''").groupBy("source", "target").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, s: Settings = Settings()) -> DataFrame:
    """seeds (host, seed), links (source, target, n) -> host, score after ``s.rounds`` rounds.

    In each round a host has (100 - damping) % of its seed and, from every host that
    links to it, damping % of that one's score times the link's share of all its links.
    """
    degree = links.groupBy("source").agg(F.sum("n").alias("all"))
    shares = cut(links.join(degree, "source"))
    own = seeds.select("host", F.expr(f"CAST(seed * {100 - s.damping} AS BIGINT) div 100").alias("score"))
    if shares.isEmpty():
        return own.groupBy("host").agg(F.sum("score").alias("score"))
    own = cut(own)
    score = own
    for done in range(1, s.rounds + 1):
        given = score.join(shares, score["host"] == shares["source"]).select(F.col("target").alias("host"), F.expr(f"CAST(score AS DECIMAL(20, 0)) * {s.damping} * n div (all * 100)").alias("score"))
        score = own.unionByName(given).groupBy("host").agg(F.sum("score").alias("score"))
        if done % 5 == 0 or done == s.rounds:  # a host is one row, however many link to it
            score = cut(score)
    return score


def judge_urls(pages: DataFrame, rules: Rules, s: Settings = Settings()) -> DataFrame:
    """pages (page_id, url, html) -> page_id, host, path, rule, verdict, trust, distrust.

    One row per row of ``pages``, repeated ones too. A null url or one without :// has an
    empty host and path: no rule fits, no links, allowed. Pages of hosts that no score
    reaches are allowed. Null html has no links. An empty table gives an empty table.
    Other columns are ignored. ``trust`` and ``distrust`` are the host's, in ``s.unit``.
    """
    if len(rules) > s.most_rules:
        raise ValueError(f"more than {s.most_rules} rules")
    said = dict(rules)
    judged = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    judged = judged.withColumn("rule", rule_of(rules, F.col("host"), F.col("path")))
    allowed, blocked = [[r for r, v in said.items() if v == verdict] for verdict in ("allow", "block")]
    # a host is one row from here on
    hosts = cut(
        judged.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("rule").isin(allowed)).alias("good"), F.count_if(F.col("rule").isin(blocked)).alias("bad"))
    )
    seed = lambda count: hosts.filter(f"{count} > 0").select("host", F.expr(f"CAST({count} AS DECIMAL(20, 0)) * {s.unit} div n").alias("seed"))
    links = cut(host_links(pages))
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"), "n")
    trust, distrust = propagate(seed("good"), links, s), propagate(seed("bad"), back, s)
    both = trust.select("host", F.col("score").alias("trust"), F.lit(0).cast("long").alias("distrust")).unionByName(
        distrust.select("host", F.lit(0).cast("long").alias("trust"), F.col("score").alias("distrust"))
    )
    scores = both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    by_host = F.when(F.col("distrust") - F.col("trust") >= s.margin, "block").otherwise("allow")
    by_rule = F.when(F.col("rule").isin(allowed), "allow").when(F.col("rule").isin(blocked), "block")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return judged.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_host).alias("verdict"), zero("trust"), zero("distrust"))
