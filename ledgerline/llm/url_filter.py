"""URL filter: rules by host and path, and trust spread over the graph of hosts.

Every url gets its host and path and the longest rule that fits. For urls that
no rule decides, two rankings decide: a personalised PageRank from hosts where an
allow rule fits, along links, and one of distrust from hosts where a block rule
fits, against links (who links to blocked hosts is suspect). The edges of the
host graph are the links between hosts in the pages' html, and one from every
subdomain to its parent host where the parent or a sibling has pages. A host's
verdict is block when its distrust is over `threshold` times its trust and
positive, else allow.

A null url, or one without ://, has an empty host and path, fits no rule and is
allowed. Rows are judged one by one, so repeated rows repeat; extra columns are
ignored. Only JVM expressions, joins and aggregates are used; the edges are checkpointed
once, and the scores every few rounds, until no host's score changes any more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (host, path, verdict), as the rules are given.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, THRESHOLD = 0.85, 1.0
#: Scores have converged when none changes by more than this share of itself in a round; that is asked every CHECKED rounds.
TOLERANCE, CHECKED = 1e-6, 4
#: Host tables up to this many rows are broadcast (hosts are bounded by it times 300 bytes); beyond it both sides are shuffled.
BROADCAST_HOSTS = 100_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, rule_host: str) -> Column:
    return (host == rule_host) | host.endswith("." + rule_host)


def _ordered(rules):
    """Longest first: by the whole rule, so that of two that fit the more special one wins."""
    return sorted(rules, key=lambda r: -len(r[0] + r[1]))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as struct<rule, verdict>; null if none does."""
    found = [F.when(_fits(host, h) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in _ordered(rules)]
    return F.coalesce(*found, F.lit(None).cast("struct<rule:string,verdict:string>"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): weights of a host's edges sum to 1. Links within a host are no edges."""
    own = pages.select(host_of(F.col("url")).alias("src"), F.col("html")).filter(F.col("src") != "")
    links = own.select("src", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), F.lit(1)))).alias("url"))
    links = links.select("src", host_of(F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = own.select("src").distinct()
    parents = hosts.select("src", F.regexp_extract("src", r"^[^.]+\.(.+\..+)$", 1).alias("dst"), F.lit(1).cast("long").alias("n"))
    edges = links.unionByName(parents).filter((F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    totals = edges.groupBy("src").agg(F.sum("n").alias("t"))
    return edges.join(totals, "src").select("src", "dst", (F.col("n") / F.col("t")).alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: (host, score). `edges`: (src, dst, w); `seeds`: (host, seed), seeds summing to 1.

    A host's rank moves along its edges; what has no edge to go on goes back to
    no one, which only scales the scores. Each round is one join and one
    aggregate whose partial sums are made before the shuffle. Without `rounds`, they
    go on until no score changes by more than `tolerance` of itself, so that every
    host that a seed reaches has one, and the whole changes by no more than that share.
    """
    score = seeds.select("host", F.col("seed").alias("score"), F.lit(0.0).alias("before"))
    start = seeds.select("host", ((1 - damping) * F.col("seed")).alias("score"), F.lit(0.0).alias("before"))
    done = 0
    while rounds is None or done < rounds:
        moved = edges.join(score.select(F.col("host").alias("src"), "score"), "src").select(F.col("dst").alias("host"), (damping * F.col("w") * F.col("score")).alias("score"), F.lit(0.0).alias("before"))
        last = score.select("host", F.lit(0.0).alias("score"), F.col("score").alias("before"))
        score = moved.unionByName(start).unionByName(last).groupBy("host").agg(F.sum("score").alias("score"), F.sum("before").alias("before"))
        done += 1
        if done % CHECKED == 0:
            score = common.checkpointed(score)
            moving = F.abs(F.col("score") - F.col("before")) > tolerance * F.col("score")
            if rounds is None and score.filter(moving).isEmpty():
                break
    return score.select("host", "score")


def _seeds(hosts: DataFrame, rules, verdict: str) -> DataFrame:
    """Hosts that a rule of this verdict fits, whatever the path, with shares of 1 by their pages."""
    fits = reduce(lambda a, b: a | b, [_fits(F.col("host"), h) for h, _, v in rules if v == verdict], F.lit(False))
    own = hosts.filter(fits)
    total = own.agg(F.sum("pages").alias("t"))
    return own.crossJoin(F.broadcast(total)).select("host", (F.col("pages") / F.col("t")).alias("seed"))


def host_scores(pages: DataFrame, rules=RULES, rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust) of all hosts that have any."""
    edges = common.checkpointed(host_edges(pages))
    hosts = common.checkpointed(pages.select(host_of(F.col("url")).alias("host")).filter(F.col("host") != "").groupBy("host").agg(F.count("*").alias("pages")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    out_of = back.groupBy("src").agg(F.sum("w").alias("t"))
    back = back.join(out_of, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("w"))
    trust = propagate(edges, _seeds(hosts, rules, "allow"), rounds).withColumnRenamed("score", "trust")
    distrust = propagate(back, _seeds(hosts, rules, "block"), rounds).withColumnRenamed("score", "distrust")
    return hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    scores = common.checkpointed(host_scores(pages, rules))
    if scores.count() <= BROADCAST_HOSTS:
        scores = F.broadcast(scores)
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = own.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).join(scores, "host", "left")
    bad = F.coalesce((F.col("distrust") > 0) & (F.col("distrust") > threshold * F.col("trust")), F.lit(False))
    return found.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
#: Scores as sums over walks of every length, up to 300 edges.
SQL = rf"""
WITH RECURSIVE rules(rh, rp, rv) AS (VALUES {_VALUES}), p AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), fits AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
), hosts AS (SELECT host, count(*) AS pages FROM p WHERE host <> '' GROUP BY host), links AS (
  SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '(?i)href\s*=\s*["'']?((?:https?:)?//[^"''\s>]+)', 1))) AS url FROM p WHERE host <> ''
), raw AS (
  SELECT src, translate(regexp_extract(substr(url, strpos(url, '//') + 2), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst, 1 AS n FROM links
  UNION ALL SELECT host, regexp_extract(host, '^[^.]+\.(.+\..+)$', 1), 1 FROM hosts
), edges AS MATERIALIZED (
  SELECT src, dst, sum(n) / sum(sum(n)) OVER (PARTITION BY src) AS w FROM raw WHERE dst <> '' AND src <> dst GROUP BY src, dst
), back AS MATERIALIZED (SELECT dst AS src, src AS dst, w / sum(w) OVER (PARTITION BY dst) AS w FROM edges), seeds AS (
  SELECT host, verdict, pages / sum(pages) OVER (PARTITION BY verdict) AS seed FROM (SELECT DISTINCT host, pages, rv AS verdict FROM hosts JOIN rules ON host = rh OR ends_with(host, '.' || rh))
), trust AS (
  SELECT host, 0 AS k, {round(1 - DAMPING, 9)} * seed AS m FROM seeds WHERE verdict = 'allow'
  UNION ALL SELECT dst, k + 1, sum({DAMPING} * w * m) FROM trust JOIN edges ON src = host WHERE k < 300 GROUP BY dst, k + 1
), distrust AS (
  SELECT host, 0 AS k, {round(1 - DAMPING, 9)} * seed AS m FROM seeds WHERE verdict = 'block'
  UNION ALL SELECT dst, k + 1, sum({DAMPING} * w * m) FROM distrust JOIN back ON src = host WHERE k < 300 GROUP BY dst, k + 1
), bad AS (
  SELECT d.host FROM (SELECT host, sum(m) AS d FROM distrust GROUP BY host) d LEFT JOIN (SELECT host, sum(m) AS t FROM trust GROUP BY host) t USING (host) WHERE d > 0 AND d > {THRESHOLD} * coalesce(t, 0)
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN fits USING (page_id)
"""
