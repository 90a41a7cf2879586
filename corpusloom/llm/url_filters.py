"""Operator 7: URL rules, and trust propagated over the link graph for hosts that no rule decides.

A rule (host and path prefix) fits its host and all subdomains; the longest that fits wins. For the rest, edges run between
hosts: from a page's host to the host of every whole or scheme-relative URL in its html (links, canonical and base addresses
alike), whether or not that host has pages here, and to every known host named in the text. Relative links stay on their host
and are no edges. Trust spreads from hosts with allowed pages by personalised PageRank along the edges; distrust spreads from
hosts with blocked pages along the reversed edges, so that who links to blocked hosts is distrusted. A host without pages
counts as one page with the path / for the rules, so hosts that link to the same blocked site are distrusted without its
pages. What reaches hosts without edges goes back to the seeds: scores of a kind add up to 1. Steps end when no score changes
by more than TOLERANCE of itself, so every host that mass can reach has its share, however far it is. A host is blocked where
its distrust exceeds RATIO times its trust.

Defined results: a null url, or one without ://, has empty host and path and, as no rule fits and no host is known, is
allowed; null html names no hosts; a host without edges or seeds is allowed; equal rows give equal results; empty tables
give empty results; other columns are ignored. Rules are matched per distinct host, so a hot host costs one lookup; edges
are distinct before they are joined, and each step's sums are taken before the shuffle. Tables are written to the shared
folder every few steps, which bounds the lineage; nothing about hosts is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small

#: (verdict, host, path prefix)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING, TOLERANCE, RATIO, CUT_EVERY = 0.85, 1e-7, 1.0, 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url):
    """Columns host and path of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(v, h, p, h + p) for v, h, p in rules], "verdict string, rule_host string, rule_path string, rule string")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each host the rules of itself and the domains above it, as (length, rule, path, verdict)."""
    parts = F.split("host", r"\.")
    above = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("suffix"))
    fits = above.join(rules, F.col("suffix") == F.col("rule_host"))
    return fits.groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("n"), "rule", F.col("rule_path").alias("p"), F.col("verdict").alias("v"))).alias("rules"))


def with_rule(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (with host, path) and the winning rule and its verdict, null where none fits."""
    hosts = materialize(pages.select("host").distinct(), "url-hosts")
    by_host, _ = small(materialize(host_rules(hosts, rules).withColumnRenamed("host", "r_host"), "url-rules"))
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["p"])))
    return pages.join(by_host, F.col("host") == F.col("r_host"), "left").withColumn("best", best).withColumn("rule", F.col("best.rule")).withColumn("ruled", F.col("best.v")).drop("best", "rules", "r_host")


def mentions(html):
    """(linked, named): hosts of whole and scheme-relative URLs in html without closing punctuation; and, as they stand, these
    and names with an inner dot. Lower-cased; the possessive runs make the scan linear."""
    urls = F.regexp_extract_all(html, F.lit(r"""(?:://|["'=]//)([^/?#\s"'<>]++)"""), F.lit(1))
    found = F.regexp_extract_all(html, F.lit(r"(?<![A-Za-z0-9.-])[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"), F.lit(0))
    lower = lambda x: F.translate(x, _UPPER, _LOWER)
    linked = F.array_distinct(F.filter(F.transform(urls, lambda x: F.rtrim(lower(x), F.lit(".,;:!)"))), lambda x: x != ""))
    return linked, F.array_except(F.concat(F.transform(urls, lower), F.transform(found, lambda x: F.rtrim(lower(x), F.lit(".")))), linked)


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, pages): how many pages of src link to dst or name it; hosts that are only named must be known."""
    linked, named = mentions(F.col("html"))
    target = lambda sure: lambda h: F.struct(h.alias("dst"), F.lit(sure).alias("linked"))
    to = F.concat(F.transform(linked, target(1)), F.transform(named, target(0)))
    found = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(to).alias("to")).select("src", "to.*").filter("src <> dst")
    counted = found.groupBy("src", "dst").agg(F.count("*").alias("pages"), F.max("linked").alias("linked"))
    known = hosts.select(F.col("host").alias("known"))
    return counted.join(known, F.col("dst") == F.col("known"), "left").filter("linked = 1 or known is not null").select("src", "dst", "pages")


def settled(before: DataFrame, after: DataFrame, tolerance: float) -> bool:
    """Whether no score of after differs from before's by more than tolerance of itself; scores of before stay in after."""
    old = before.select(F.col("kind").alias("o_kind"), F.col("host").alias("o_host"), F.col("score").alias("old"))
    both = after.join(old, (F.col("kind") == F.col("o_kind")) & (F.col("host") == F.col("o_host")), "left")
    return both.filter(F.abs(F.col("score") - F.coalesce("old", F.lit(0.0))) > tolerance * F.col("score")).isEmpty()


def propagate(seeds: DataFrame, edges: DataFrame, damping=DAMPING, steps=None, tolerance=TOLERANCE) -> DataFrame:
    """(kind, host, score) after the given number of steps, or once settled. seeds: kind, host, seed (adding up to 1 a kind);
    edges: kind, src, dst, w with weights of a source adding up to 1. Mass at hosts without edges is not handed on: giving it back
    to the seeds changes all scores by one factor, which trust() takes out."""
    rank = last = seeds.select("kind", "host", F.col("seed").alias("score"))
    done = 0
    while steps is None or done < steps:
        out = rank.withColumnRenamed("host", "src").join(edges, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("w") * damping).alias("score"))
        back = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
        rank = out.unionByName(back).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        done += 1
        if done % CUT_EVERY == 0:
            rank = materialize(rank, "url-rank")
            if steps is None and settled(last, rank, tolerance):
                break
            last = rank
    return rank


def trust(ruled: DataFrame, edges: DataFrame, damping=DAMPING, steps=None) -> DataFrame:
    """(host, trust, distrust), each adding up to 1. Seeds are the shares of all allowed, and of all blocked, pages."""
    counts = ruled.filter("ruled is not null").groupBy(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").alias("n"))
    counts = materialize(counts, "url-seeds")
    total = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = counts.join(F.broadcast(total), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("seed"))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "pages").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "pages"))
    out = both.groupBy("kind", "src").agg(F.sum("pages").alias("all_pages"))
    weighted = materialize(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("pages") / F.col("all_pages")).alias("w")), "url-edges")
    rank = propagate(seeds, weighted, damping, steps)
    mass = rank.groupBy("kind").agg(F.sum("score").alias("mass"))
    rank = rank.join(F.broadcast(mass), "kind").select("kind", "host", (F.col("score") / F.col("mass")).alias("score"))
    return rank.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")))


def judge(pages: DataFrame, rules=RULES, page_id="page_id", url="url", html="html", ratio=RATIO) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    p = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    ruled = materialize(with_rule(p.drop("html"), rules_table(spark, rules)), "url-ruled")
    hosts = ruled.select("host").distinct().filter("host <> ''")
    edges = materialize(host_edges(p, hosts), "url-links")
    others = edges.select(F.col("dst").alias("host")).distinct().join(hosts, "host", "left_anti").withColumn("path", F.lit("/"))
    seen = ruled.select("host", "ruled").unionByName(with_rule(others, rules_table(spark, rules)).select("host", "ruled"))
    scores = trust(seen, edges).join(hosts, "host", "left_semi").withColumnRenamed("host", "s_host")
    scores, _ = small(materialize(scores, "url-trust"))
    out = ruled.join(scores, F.col("host") == F.col("s_host"), "left")
    t, d = (F.coalesce(F.col(k), F.lit(0.0)) for k in ("trust", "distrust"))
    by_graph = F.when(d > t * F.lit(float(ratio)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_graph).alias("verdict"), t.alias("trust"), d.alias("distrust"))
