"""URL filters: fixed rules first, then trust and distrust spread over the graph of hosts.

Hosts whose pages the rules allow are trusted seeds, those whose pages they block are distrusted ones,
each by the share of its pages. Trust is personalised PageRank along links; distrust runs
against them, so a host is as suspect as what it links to. Both move in one join and one sum a round, over
edges that were counted once for each pair of hosts. A host is blocked where its distrust
exceeds a threshold and its trust. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Share of a host's score that moves on each link, and how often it moves; what moves later is under 0.6^9 of a seed.
DAMPING, ROUNDS = 0.6, 8
#: Distrust above which a host is blocked, if its trust is less; 1 is a host all of whose pages the rules block.
THRESHOLD = 0.5
#: Rounds after which scores are settled, so that lineage stays short.
EVERY = 4
#: Blocked hosts up to which they are sent to every task; more are joined by a shuffle.
SENT = 100_000

LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""
AUTHORITY, PATH = "://([^/?#]*)", "://[^/?#]*([^?#]*)"


def lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def host(url: Column) -> Column:
    """Host of a URL, with user and port if it has them; empty for null or where there is no ``://``."""
    return F.coalesce(lower(F.regexp_extract(url, AUTHORITY, 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def fitting(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does; of equally long ones the first given wins.

    A rule is a host, which stands for its subdomains too, directly followed by the beginning of a path.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: -len(r[0])):  # the sort keeps the order of equally long ones
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.coalesce(rule, F.when(fits, text)), F.coalesce(verdict, F.when(fits, says))
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, share): of a host's links to other hosts, the share that leads to ``dst``; a page counts once for each host it links to.

    Links without a host lead to the page's own and don't count, nor do those of pages without one.
    """
    linked = pages.where((F.col("host") != "") & F.col("html").contains("//"))
    found = linked.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lower))).alias("dst"))
    edges = settle(found.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links")), "edges")
    out = edges.groupBy("src").agg(F.sum("links").alias("all"))
    return edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("all")).alias("share"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from ``seeds`` (host, trusted, blocked: shares of its pages).

    Both are sums of what arrives and the host's own share, so the total is that of a PageRank divided by
    1 - damping. Hosts no score reaches are left out.
    """
    kinds = F.array(F.struct(F.lit("trust").alias("kind"), F.col("trusted").alias("score")), F.struct(F.lit("distrust").alias("kind"), F.col("blocked").alias("score")))
    own = settle(seeds.select("host", F.explode(kinds).alias("k")).select("k.kind", "host", "k.score").where("score > 0"), "seeds")
    ways = F.array(F.struct(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to")), F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to")))
    moves = settle(edges.select("share", F.explode(ways).alias("w")).select("w.kind", "w.host", "w.to", "share"), "moves")
    scores = own
    for i in range(rounds):
        moved = scores.join(moves, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        scores = moved.unionByName(own).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if (i + 1) % EVERY == 0 or i + 1 == rounds:
            scores = settle(scores, "scores")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    return scores.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of every row of ``pages`` (page_id, url, html).

    The longest fitting rule decides; where none fits the host's scores do. Hosts without scores, and pages
    without a host, are allowed. Null html has no links; repeated rows are judged alike
    and counted each; other columns are left aside; an empty table gives no rows. ``rules``
    become one expression, so they should be some hundred at most.
    """
    here = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "html")
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    ruled = here.withColumns({"rule": rule, "says": verdict})
    share = lambda says: F.avg(F.coalesce((F.col("says") == says).cast("double"), F.lit(0.0)))
    seeds = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))
    scores = propagate(seeds, host_edges(here), damping, rounds)
    bad = settle(scores.where((F.round("distrust", 9) > threshold) & (F.round("distrust", 9) > F.round("trust", 9))).select("host", F.lit("block").alias("scored")), "blocked")
    joined = ruled.drop("html").join(F.broadcast(bad) if bad.count() <= SENT else bad, "host", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("says", "scored", F.lit("allow")).alias("verdict"))
