"""URL rules and link-graph propagation of trust and distrust between hosts.

A rule (host, path) fits its host and all subdomains if the path starts with the
rule's; the longest fitting rule decides. Pages without a rule are judged by
their host: personalised PageRank flows from hosts that rules mostly allow,
and distrust flows backwards from hosts that rules mostly block.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.runtime import cut_lineage

#: Fixed values of the rules: verdict, host, path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
#: Rounds end when no host's score moves by this share of itself; scores below SMALLEST have no digits left to compare.
EPSILON = 1e-6
SMALLEST = 1e-300
#: A host is blocked when its distrust is at least this share of trust and distrust together.
BLOCK_SHARE = 0.5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text of the longest fitting rule (host then path) and its verdict, null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        text, verdict = F.when(fits, F.lit(name + start)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts. Relative links stay on their host and carry nothing."""
    links = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]+)"""), 1)
    found = pages.select(F.col("host").alias("src"), F.explode(links).alias("_to"))
    found = found.select("src", host_of(F.when(F.col("_to").startswith("//"), F.concat(F.lit("http:"), F.col("_to"))).otherwise(F.col("_to"))).alias("dst"))
    return found.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """Personalised PageRank: ``host, score`` for ``links (src, dst, n)`` and ``seeds (host, seed)``.

    A host shares its score over its links by their number; what a host without
    links would pass on returns to the seeds. Rounds end when no host is reached anew and
    every score moves by less than EPSILON of itself, or after ``rounds`` if given.
    """
    total = seeds.agg(F.sum("seed")).first()[0]
    if not total:
        return seeds.select("host", F.lit(0.0).alias("score"))
    start = cut_lineage(seeds.where(F.col("seed") > 0).select("host", (F.col("seed") / total).alias("seed")))
    out = links.groupBy("src").agg(F.sum("n").alias("_all"))
    shares = cut_lineage(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("_all")).alias("share")))
    score = start.select("host", F.col("seed").alias("score"))
    now, old = F.coalesce("score", F.lit(0.0)), F.coalesce("old", F.lit(0.0))
    larger = F.greatest(now, old)
    for _ in itertools.count() if rounds is None else range(rounds):
        flow = (score.join(shares, score["host"] == shares["src"]).groupBy(F.col("dst").alias("host"))
                .agg(F.sum(F.col("score") * F.col("share")).alias("got")))
        moved = flow.agg(F.sum("got")).first()[0] or 0.0
        back = 1 - damping * moved
        new = start.join(flow, "host", "full").select(
            "host", (F.coalesce("seed", F.lit(0.0)) * back + F.coalesce("got", F.lit(0.0)) * damping).alias("score"))
        new = cut_lineage(new)
        gone = new.join(score.withColumnRenamed("score", "old"), "host", "full").agg(
            F.max(F.when(larger > SMALLEST, F.abs(now - old) / larger))).first()[0] or 0.0
        score = new
        if gone < EPSILON:
            break
    return score


def judge(pages: DataFrame, rules=RULES, share: float = BLOCK_SHARE) -> DataFrame:
    """``page_id, host, path, rule, verdict`` with the host's ``trust`` and ``distrust``, for every row of ``pages``.

    Null url or one without ``://``: host and path are empty, no rule fits, allowed.
    Null html has no links. Repeated rows are judged each. Seeds are hosts with more
    than half of their pages allowed (blocked) by rules; page counts weigh nothing,
    so a large host can't drown the others. A host without any score is allowed.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    read = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    ruled = read.drop("html").withColumn("rule", text).withColumn("_said", verdict)
    hosts = cut_lineage(ruled.where(F.col("host") != "").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_said") == "allow", 1)).alias("allowed"),
        F.count(F.when(F.col("_said") == "block", 1)).alias("blocked")))
    links = cut_lineage(host_links(read))
    seed = lambda c: hosts.where(F.col(c) * 2 > F.col("n")).select("host", F.lit(1.0).alias("seed"))
    trust = propagate(links, seed("allowed"))
    distrust = propagate(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), seed("blocked"))
    scores = cut_lineage(trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
                         .fillna(0.0, ["trust", "distrust"]))
    both = F.coalesce("trust", F.lit(0.0)) + F.coalesce("distrust", F.lit(0.0))
    method = F.when((both > 0) & (F.col("distrust") >= both * share), "block").otherwise("allow")
    return ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("_said", method).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op7_url_filter(pages: DataFrame) -> DataFrame:
    return judge(pages)
