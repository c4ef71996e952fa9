"""URL filters: ordered host and path rules, and trust that flows along links for the rest.

Rules decide what they fit. All other pages are judged by their host: personalised PageRank
from hosts with allowed pages along host links gives trust; the same along reversed links from
hosts with blocked pages gives distrust, so who links to the blocked is suspect. Both
run as one iteration over (kind, host) in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.common import ascii_lower, cut, forget, pick, table

#: (verdict, host, path); a rule fits its host and all subdomains where the path begins with its.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
DAMPING = 0.85
#: Ranks of a kind add up to 1; they are within this of their limits, in sum.
TOLERANCE = 1e-6
STEPS = 8
#: A host is blocked if its distrust is over this many times its trust and over this many
#: times what an even spread over all hosts would give it, by more than SLACK.
OVER_TRUST = 2.0
OVER_EVEN = 1.5
SLACK = 1e-5
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) of links between different hosts, weights adding to 1 for each src."""
    links = pages.where(F.col("html").contains("//")).select(
        host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link")
    )
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    links = links.select("src", host_of(full).alias("dst")).where("src != '' and dst != '' and src != dst")
    links = links.groupBy("src", "dst").agg(F.count("*").alias("n"))
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    return links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(kind, host, rank): personalised PageRank for each kind, adding to 1. seeds: kind, host, seed (adding
    to 1 per kind); edges: kind, src, dst, weight (adding to 1 per src). What a host without
    links holds goes back to the seeds.

    That only scales all ranks of a kind, so rounds add seeds and what links pass on, and the sum is made 1 at the
    end. Every ``STEPS`` rounds the ranks are written to the shared folder. What a round adds shrinks
    by ``damping`` at least, so the last rounds bound all that could follow; it ends below ``tolerance``."""
    seeds = cut(seeds, "seeds")
    start = seeds.select("kind", "host", F.col("seed").alias("rank"))
    rank, last, total = start, None, seeds.agg(F.sum("seed")).first()[0] or 0.0
    shrunk = damping**STEPS
    while True:
        for _ in range(STEPS):
            passed = edges.join(rank.withColumnRenamed("host", "src"), ["kind", "src"])
            passed = passed.select("kind", F.col("dst").alias("host"), (F.col("weight") * F.col("rank") * damping).alias("rank"))
            rank = start.unionByName(passed).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        rank = cut(rank, "ranks")
        if last is not None:
            forget(last)
        last, before = rank, total
        total = rank.agg(F.sum("rank")).first()[0] or 0.0
        if (total - before) * shrunk / (1 - shrunk) <= tolerance:
            break
    forget(seeds)
    sums = rank.groupBy("kind").agg(F.sum("rank").alias("all"))
    return rank.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("rank") / F.col("all")).alias("rank"))  # a row per kind


def judge(pages: DataFrame, rules=RULES, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page (page_id, url, html).

    A null url, or one without ``://``, has empty host and path, which no rule fits, and is
    allowed. Pages of hosts that no trust or distrust reaches are allowed. Repeated rows give
    repeated rows; a null html has no links; other columns are ignored; empty tables give
    empty results. Trust of all hosts adds up to 1, and so does distrust.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seen = pick(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    seen = seen.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    hosts = cut(
        seen.where("host != ''")
        .groupBy("host")
        .agg(F.sum((F.col("fit.verdict") == "allow").cast("long")).alias("allow"), F.sum((F.col("fit.verdict") == "block").cast("long")).alias("block")),
        "hosts",
    )
    seeds = hosts.select("host", F.stack(F.lit(2), F.lit("allow"), "allow", F.lit("block"), "block").alias("kind", "n")).where("n > 0")
    seeds = seeds.join(seeds.groupBy("kind").agg(F.sum("n").alias("all")), "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("seed"))
    edges = cut(host_edges(pick(pages, "url", "html")), "links")
    back = edges.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    shares = back.groupBy("src").agg(F.sum("weight").alias("all"))
    back = back.join(shares, "src").select("kind", "src", "dst", (F.col("weight") / F.col("all")).alias("weight"))
    both = cut(edges.select(F.lit("allow").alias("kind"), "src", "dst", "weight").unionByName(back), "links")
    ranks = propagate(seeds, both, tolerance)
    ranks = ranks.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "allow", F.col("rank"))).alias("trust"), F.sum(F.when(F.col("kind") == "block", F.col("rank"))).alias("distrust")
    )
    even = 1 / max(hosts.count(), 1)
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdicts = hosts.select("host").join(ranks, "host", "left").select(
        "host",
        trust.alias("trust"),
        distrust.alias("distrust"),
        ((distrust > OVER_TRUST * trust + SLACK) & (distrust > OVER_EVEN * even + SLACK)).alias("bad"),
    )
    verdicts = cut(verdicts, "verdicts")
    for t in (hosts, edges, both):
        forget(t)
    out = seen.join(verdicts, "host", "left")
    other = F.when(F.col("bad"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", other).alias("verdict"), "trust", "distrust")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


_FOUND = " ".join(
    f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%' THEN {{'verdict': '{v}', 'rule': '{h + p}'}}" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
)
_HOST = "translate(regexp_extract({}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH RECURSIVE seen AS (SELECT page_id, html, {_HOST.format("coalesce(url, '')")} AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
fit AS (SELECT *, CASE {_FOUND} END AS f FROM seen),
hosts AS (SELECT host, count(*) FILTER (f.verdict = 'allow') AS allow, count(*) FILTER (f.verdict = 'block') AS block FROM fit WHERE host <> '' GROUP BY 1),
seeds AS (SELECT 'allow' AS kind, host, allow / sum(allow) OVER () AS seed FROM hosts WHERE allow > 0 UNION ALL SELECT 'block', host, block / sum(block) OVER () FROM hosts WHERE block > 0),
l0 AS (SELECT host AS src, unnest(regexp_extract_all(html, '\bhref\s*=\s*["'']?\s*((?:https?:)?//[^"''\s>]+)', 1, 'i')) AS link FROM seen WHERE contains(html, '//')),
l1 AS (SELECT src, {_HOST.format("CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END")} AS dst FROM l0),
l2 AS (SELECT src, dst, count(*) AS n FROM l1 WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
l3 AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM l2),
edges AS (SELECT 'allow' AS kind, src, dst, weight FROM l3 UNION ALL SELECT 'block', dst, src, weight / sum(weight) OVER (PARTITION BY dst) FROM l3),
ranks AS (SELECT 0 AS k, kind, host, CAST(seed AS DOUBLE) AS rank FROM seeds UNION ALL
  SELECT k, kind, host, sum(rank) FROM (
    SELECT k + 1 AS k, ranks.kind, dst AS host, {DAMPING} * weight * rank AS rank FROM ranks JOIN edges ON ranks.kind = edges.kind AND ranks.host = src WHERE k < 150
    UNION ALL SELECT t.k + 1, seeds.kind, seeds.host, (1 - {DAMPING} * t.flow) * seed FROM seeds JOIN (
      SELECT k, ranks.kind, sum(coalesce(rank * out, 0)) AS flow FROM ranks LEFT JOIN (SELECT kind, src, sum(weight) AS out FROM edges GROUP BY 1, 2) o ON ranks.kind = o.kind AND ranks.host = src WHERE k < 150 GROUP BY 1, 2) t ON t.kind = seeds.kind)
  GROUP BY 1, 2, 3),
v AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'block'), 0) AS distrust, coalesce(sum(rank) FILTER (kind = 'allow'), 0) AS trust FROM ranks WHERE k = 150 GROUP BY 1)
SELECT page_id, host, path, f.rule AS rule, coalesce(f.verdict, CASE WHEN distrust > {OVER_TRUST} * trust + {SLACK} AND distrust > {OVER_EVEN} / (SELECT count(*) FROM hosts) + {SLACK} THEN 'block' ELSE 'allow' END) AS verdict
FROM fit LEFT JOIN v USING (host)
"""

QUERIES = {"op4_url_filter": op4_url_filter}
ORACLES = {"op4_url_filter": SQL}
