"""URL filters by a path-template tree.

Listed rules decide the urls they fit (host and all its subdomains, path prefix, the longest
rule wins). They also label those urls, and the method decides the others: paths are cut into
segments, and per host a tree of segments is built whose variable branches become wildcards:

* a segment of digits (with or without an extension) is generalised at once;
* of the branches under one node, those with less than ``MIN_SHARE`` of its urls are not told
  apart (one wildcard branch), but one with labels stays by itself when its share of blocked
  urls is statistically another than that of the others' labels together;
* a branch joins the node's wildcard when its share of blocked urls is statistically the same
  (two-proportion z of ``MERGE_Z`` at most);
* a branch without labels can't be tested. In a wildcard it shares the name only: its urls have
  the purity of a template without labels, whatever the labels of the other branches.

A template's purity is the share of blocked ones among its labelled urls, smoothed towards the
share of all urls of its host that are known to be blocked, that towards its domain's, and
that towards the share in the whole table. So a template without labels is rejected only where
most of its host is. A url without a rule is blocked when its template's smoothed purity is
``REJECT`` or more.

Everything is DataFrame expressions and aggregates. Urls are first counted by host and
generalised path (partial sums, so a host with a third of all urls is no hot group); the tree
is built on those counts only, and urls get their template by one join.

Cases: null urls, or urls without ``://``, have an empty host and path and no rule fits them;
equal lengths can't tie, as a rule that fits is known by its host and path; repeated urls count
each time; an empty table gives no rows; columns other than id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import checkpointed

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]
DEPTH = 3          # levels of the tree that are told apart
SEGMENTS = [f"s{k}" for k in range(1, DEPTH + 1)]
MIN_SHARE = 0.05   # of its node's urls, for a branch of its own
MERGE_Z = 2.0      # branches closer than this are one
WEIGHT = 8.0       # of the coarser level's share, in urls
REJECT = 0.5


def url_host(url: Column) -> Column:
    rest = F.substring_index(F.regexp_extract(url, r"(?s)://(.*)", 1), "/", 1)
    host = F.regexp_extract(rest, r"^([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                      F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, null if none."""
    name = verdict = None
    ordered = sorted(rules or RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    for h, p, v in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def segment(path: Column, k: int) -> Column:
    """Segment k (from 1) of a path, generalised; empty beyond the path's end."""
    s = F.coalesce(F.get(F.split(path, "/"), F.lit(k)), F.lit(""))
    return F.when(s.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?\z"), F.lit("{n}")).otherwise(s)


def domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def smoothed(blocked: Column, urls: Column, prior: Column) -> Column:
    return (blocked + F.lit(WEIGHT) * prior) / (urls + F.lit(WEIGHT))


def url_shapes(urls: DataFrame) -> DataFrame:
    """(host, s1.., n urls, m labels, b blocked): one row for each generalised path of a host."""
    return urls.groupBy("host", *SEGMENTS).agg(
        F.count(F.lit(1)).alias("n"), F.count("label").alias("m"),
        F.coalesce(F.sum("label"), F.lit(0)).alias("b"))


def _alike(b: Column, m: Column, wb: Column, wm: Column) -> Column:
    """Whether b blocked of m labelled and wb of wm are statistically one share; null without labels."""
    b, m, wb, wm = (c.cast("double") for c in (b, m, wb, wm))
    pooled = (b + wb) / (m + wm)
    spread = pooled * (1 - pooled) * (1 / m + 1 / wm)
    away = b / m - wb / wm
    return F.when((m > 0) & (wm > 0), away * away <= MERGE_Z * MERGE_Z * spread)


def _branches(shapes: DataFrame, k: int) -> DataFrame:
    """(host, node, segment k, t, bare): the template segment that each branch at level k becomes,
    and whether the branch is in a wildcard without labels of its own."""
    branch = shapes.groupBy("host", "node", f"s{k}").agg(
        F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("b").alias("b"))
    all_of = branch.groupBy("host", "node").agg(F.sum("n").alias("all"))
    sized = branch.join(all_of, ["host", "node"]).withColumn("rare", F.col("n") < MIN_SHARE * F.col("all"))
    rares = sized.groupBy("host", "node").agg(
        F.sum(F.when(F.col("rare"), F.col("m")).otherwise(0)).alias("rm"),
        F.sum(F.when(F.col("rare"), F.col("b")).otherwise(0)).alias("rb"))
    tested = sized.join(rares, ["host", "node"]).withColumn("joins", F.col("rare") & F.coalesce(
        _alike(F.col("b"), F.col("m"), F.col("rb") - F.col("b"), F.col("rm") - F.col("m")), F.lit(True)))
    wild = tested.groupBy("host", "node").agg(  # the wildcard begins with the rare branches
        F.sum(F.when(F.col("joins"), F.col("m")).otherwise(0)).alias("wm"),
        F.sum(F.when(F.col("joins"), F.col("b")).otherwise(0)).alias("wb"),
        F.max("joins").alias("some"))
    alike = F.coalesce(_alike(F.col("b"), F.col("m"), F.col("wb"), F.col("wm")), F.lit(False))
    starred = F.col("joins") | (F.col("some") & ~F.col("rare") & alike)
    return tested.join(wild, ["host", "node"]).select(
        "host", "node", f"s{k}", F.when(starred, "*").otherwise(F.col(f"s{k}")).alias("t"),
        (starred & (F.col("m") == 0)).alias("bare"))


def url_templates(shapes: DataFrame) -> DataFrame:
    """shapes with ``template`` and its smoothed ``purity``."""
    rows = shapes.withColumn("node", F.lit("")).withColumn("apart", F.lit(False))
    for k in range(1, DEPTH + 1):
        # each level reads the one above several times: without a cut the plan grows as a power
        rows = checkpointed(rows.join(_branches(rows, k), ["host", "node", f"s{k}"])
                            .withColumn("node", F.concat("node", F.lit("/"), "t"))
                            .withColumn("apart", F.col("apart") | F.col("bare")).drop("t", "bare"))
    template = rows.groupBy("host", "node").agg(F.sum("b").alias("b"), F.sum("m").alias("m"))
    host = shapes.groupBy("host").agg(F.sum("b").alias("hb"), F.sum("n").alias("hn"))
    host = host.withColumn("domain", domain(F.col("host")))
    wide = host.groupBy("domain").agg(F.sum("hb").alias("db"), F.sum("hn").alias("dn"))
    every = host.agg(F.coalesce(F.try_divide(F.sum("hb").cast("double"), F.sum("hn").cast("double")),
                                F.lit(0.0)).alias("p"))  # one row
    host = (host.join(wide, "domain").crossJoin(every)
            .withColumn("p", smoothed(F.col("db"), F.col("dn"), F.col("p")))
            .withColumn("p", smoothed(F.col("hb"), F.col("hn"), F.col("p"))).select("host", "p"))
    template = template.join(host, "host").select(
        "host", "node", "p", smoothed(F.col("b"), F.col("m"), F.col("p")).alias("purity"))
    return rows.join(template, ["host", "node"]).select(
        "host", *SEGMENTS, F.col("node").alias("template"),
        F.when(F.col("apart"), F.col("p")).otherwise(F.col("purity")).alias("purity"))


def judge_urls(pages: DataFrame, rules=None) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, template, purity."""
    urls = pages.select("page_id", F.col("url").cast("string").alias("url")).select(
        "page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    urls = urls.select("*", name.alias("rule"), verdict.alias("listed"),
                       (verdict == "block").cast("int").alias("label"),
                       *(segment(F.col("path"), k).alias(f"s{k}") for k in range(1, DEPTH + 1)))
    judged = url_templates(checkpointed(url_shapes(urls)))
    return urls.join(judged, ["host", *SEGMENTS]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("listed", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"),
        "template", "purity")
