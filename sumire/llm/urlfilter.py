"""URL filters: rules by host and path, then trust and distrust spread over the hosts' links. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, table

#: (verdict, host, path) of a rule; it fits the host and its subdomains where the path starts with the rule's.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Damping, and the distrust from which a host is blocked, as a share of its trust and distrust and of a wholly blocked host's seed.
DAMPING, SHARE = 0.85, 0.5
#: Spreading ends with the round that changes no rank by more than this share of the largest seed's; each round shrinks changes by the damping, which bounds the rounds.
TOLERANCE = 1e-3
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does. Rules are a short list, held in the plan."""
    text = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links of each host's pages to other hosts; relative ones stay on the host and make none."""
    hrefs = F.regexp_extract_all("html", F.lit(r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'>\s]*)"), 1)
    links = pages.where("html like '%//%'").select(host_of(F.col("url")).alias("src"), F.explode(hrefs).alias("to"))
    dst = F.translate(F.regexp_extract("to", "(?s)//([^/?#]*)", 1), UPPER, LOWER)
    return links.select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def shares(edges: DataFrame) -> DataFrame:
    """(src, dst, share): each link's share of its source's links."""
    return edges.join(edges.groupBy("src").agg(F.sum("n").alias("all")), "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))


def spread(seeds: DataFrame, ways: DataFrame, scratch: Scratch, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): personalised PageRank from seeds (host, seed) along ways (a, b, share): a's rank goes to b by so much.

    A rank is (1 - DAMPING) of the own seed and DAMPING of what comes in. Rounds end when none changes by more than tolerance of (1 - DAMPING).
    """
    ranks = scratch.save(seeds.select("host", (F.col("seed") * (1 - DAMPING)).alias("rank"), F.lit(0.0).alias("change")))
    while True:
        got = ways.join(ranks, ways["a"] == ranks["host"]).groupBy("b").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        base = seeds.select("host", "seed").join(got, F.col("host") == F.col("b"), "full").select(F.coalesce("host", "b").alias("host"), ((1 - DAMPING) * F.coalesce("seed", F.lit(0.0)) + DAMPING * F.coalesce("got", F.lit(0.0))).alias("rank"))
        old = ranks.select(F.col("host").alias("old_host"), F.col("rank").alias("old"))
        new = scratch.save(base.join(old, F.col("host") == F.col("old_host"), "left").select("host", "rank", F.abs(F.col("rank") - F.coalesce("old", F.lit(0.0))).alias("change")))
        scratch.drop(ranks)
        ranks = new
        if (ranks.agg(F.max("change")).first()[0] or 0.0) <= tolerance * (1 - DAMPING):
            return ranks.select("host", "rank")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row.

    Where no rule fits, the host decides. Its seeds are the shares of its pages that rules allow (trust) and block
    (distrust). Trust goes along links, divided among a host's own links as in PageRank. Distrust goes against them: a host takes of
    each host that it links to by that link's share of its own links, so how many others link there doesn't matter. The host is blocked if its
    distrust is over half of both and at least what half of its own pages' being blocked would give. A null url, or one
    without ://, has an empty host and path; the empty host has no links and is allowed unless a rule fits. Null html has no links;
    repeated rows count each; of the columns only page_id, url and html are read.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    each = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    each = each.withColumns({"rule": rule, "by_rule": verdict})
    hosts = scratch.save(each.where("host <> ''").groupBy("host").agg(F.avg(F.expr("CAST(by_rule <=> 'allow' AS DOUBLE)")).alias("trust"), F.avg(F.expr("CAST(by_rule <=> 'block' AS DOUBLE)")).alias("distrust")))
    edges = scratch.save(host_edges(pages))
    ways = scratch.save(shares(edges))
    good = spread(hosts.select("host", F.col("trust").alias("seed")), ways.select(F.col("src").alias("a"), F.col("dst").alias("b"), "share"), scratch)
    bad = spread(hosts.select("host", F.col("distrust").alias("seed")), ways.select(F.col("dst").alias("a"), F.col("src").alias("b"), "share"), scratch)
    ranks = good.withColumnRenamed("rank", "trust").join(bad.withColumnRenamed("rank", "distrust"), "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    blocked = scratch.save(ranks.where(F.expr(f"distrust > {SHARE}D * (trust + distrust) and distrust >= {SHARE * (1 - DAMPING)}D - 1e-9")).select(F.col("host").alias("__blocked")))
    out = each.join(blocked, each["host"] == blocked["__blocked"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("__blocked").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _sql() -> str:
    text = verdict = "NULL"
    for kind, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        text, verdict = f"CASE WHEN {fits} THEN '{h}{p}' ELSE {text} END", f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    steps = ""
    for name, src, dst in (("trust", "src", "dst"), ("distrust", "dst", "src")):
        steps += f", s_{name} AS MATERIALIZED (SELECT {src} AS a, {dst} AS b, n / sum(n) OVER (PARTITION BY src) AS share FROM edges), {name}0 AS MATERIALIZED (SELECT host, {1 - DAMPING} * {name} AS r FROM hosts)"
        for k in range(1, ROUNDS + 1):
            steps += f", {name}{k} AS MATERIALIZED (SELECT coalesce(h.host, g.b) AS host, {1 - DAMPING} * coalesce(h.{name}, 0) + {DAMPING} * coalesce(g.got, 0) AS r FROM hosts h FULL JOIN (SELECT b, sum(r * share) AS got FROM s_{name} JOIN {name}{k - 1} ON a = host GROUP BY b) g ON h.host = g.b)"
    return rf"""
WITH p AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
e AS (SELECT *, {text} AS rule, {verdict} AS by_rule FROM p),
hosts AS (SELECT host, avg(CASE WHEN by_rule = 'allow' THEN 1.0 ELSE 0 END) AS trust, avg(CASE WHEN by_rule = 'block' THEN 1.0 ELSE 0 END) AS distrust FROM e WHERE host <> '' GROUP BY host),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''>\s]*)', 1)) AS t FROM p),
edges AS (SELECT src, translate(regexp_extract(t, '(?s)//([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS dst, count(*) AS n FROM l GROUP BY ALL HAVING src <> '' AND dst <> '' AND src <> dst){steps},
b AS (SELECT t.host FROM trust{ROUNDS} t JOIN distrust{ROUNDS} d USING (host) WHERE d.r > {SHARE} * (t.r + d.r) AND d.r >= {SHARE * (1 - DAMPING)} - 1e-9)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END) AS verdict FROM e"""


SQL = {"op3_url_filter": _sql()}
