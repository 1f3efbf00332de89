"""URL filters: fixed host and path rules, and a path-template tree learned per host.

Level by level, the children of a tree node become one wildcard `*` where the segment is variable
(many distinct values for the rows), siblings whose labelled shares do not differ significantly
merge into one branch `+`, and the rest keep their text. The rules' own verdicts are the labels.

Most hosts have few labels or none, so a tree is learned twice: first from the paths of all hosts
together, then for each host, where every url counts besides its own labels as much as SMOOTH labelled
ones of the share that its path has in the first tree. A template is rejected where its share of
blocked labels, smoothed in this way, reaches PURITY.

All counts are partial aggregates over distinct (host, path), so a host with a third of all pages is
summed before any shuffle; what is joined back by host and template is dealt out by SALTS of the path
too, so that such a host lands in no single task.

Cases: a null url, or one without `://`, has empty host and path, no rule and the method's verdict
on the empty host; repeated rows count as often as they occur; ties between rules cannot occur (the
texts differ in length where both fit); an empty table gives an empty table; a very long url is one
url, its path beyond LEVELS segments one more segment; further columns of the input, whatever their
names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# Rules as (text, host, path prefix, verdict).
RULES = (
    ("org/", "org", "/", "allow"),
    ("example.org/es/", "example.org", "/es/", "block"),
    ("example.org/en/1", "example.org", "/en/1", "block"),
    ("com/fr/", "com", "/fr/", "allow"),
    ("com/de/", "com", "/de/", "block"),
)
#: Levels of the tree; what lies deeper in a path is one more segment, not left out.
LEVELS = 4
FAN, SHARE = 5, 0.2  # a position is variable with so many children, and so many to a row
Z = 1.96
SMOOTH, PURITY = 5.0, 0.7
SALTS = 16


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_index(host: Column, path: Column) -> Column:
    """Index of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("int")
    for i in sorted(range(len(RULES)), key=lambda i: len(RULES[i][0])):  # the longest is asked first
        _, h, p, _ = RULES[i]
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def _verdict(i: Column) -> Column:
    return F.get(F.array(*[F.lit(r[3]) for r in RULES]), i)


def _segments(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    deep = F.array_join(F.slice(parts, LEVELS + 1, F.greatest(F.size(parts) - LEVELS, F.lit(0))), "/")
    return F.when(F.size(parts) > LEVELS, F.array_append(F.slice(parts, 1, LEVELS), deep)).otherwise(parts)


def _with(rows: DataFrame, few: DataFrame, by: Column) -> DataFrame:
    """rows joined with `few`, which has one row a (host, template); `by` deals a host's rows out."""
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, ["host", "template", "salt"]).drop("salt")


def learn_templates(urls: DataFrame, scratch: Scratch) -> DataFrame:
    """From (host, path, n, allowed, blocked, hope), the same rows with their template; hope is the share
    of blocked labels that a url has for other reasons."""
    nodes = scratch.save(urls.withColumn("segments", _segments(F.col("path"))).withColumn("template", F.lit("")))
    for level in range(LEVELS + 1):
        at = nodes.withColumn("segment", F.get("segments", F.lit(level)))
        kids = at.where("segment is not null").groupBy("host", "template", "segment").agg(
            F.sum("n").alias("n"), F.sum("allowed").alias("a"), F.sum("blocked").alias("b"), F.sum(F.col("n") * F.col("hope")).alias("g"))
        parents = kids.groupBy("host", "template").agg(
            F.count("*").alias("fan"), F.sum("n").alias("all_n"), F.sum("a").alias("all_a"), F.sum("b").alias("all_b"), F.sum("g").alias("all_g"))
        both = _with(kids, parents, F.col("segment"))
        c = lambda x: F.col(x).cast("double")
        b1, n1 = c("b") + SMOOTH * c("g") / c("n"), c("a") + c("b") + SMOOTH
        b2 = c("all_b") - c("b") + SMOOTH * (c("all_g") - c("g")) / (c("all_n") - c("n"))
        n2 = c("all_a") - c("a") + c("all_b") - c("b") + SMOOTH
        pool = (b1 + b2) / (n1 + n2)
        alike = F.coalesce(F.abs(b1 / n1 - b2 / n2) < Z * F.sqrt(F.greatest(pool * (1 - pool), F.lit(1e-9)) * (1 / n1 + 1 / n2)), F.lit(True))
        named = (
            F.when((F.col("fan") >= FAN) & (F.col("fan") >= SHARE * F.col("all_n")), "*")
            .when(F.when(F.col("fan") > 1, alike).otherwise(False), "+")
            .otherwise(F.concat(F.lit("="), F.col("segment")))
        )
        named = both.select("host", "template", "segment", named.alias("name"))
        grown = at.join(named, ["host", "template", "segment"], "left").withColumn(
            "template", F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name")))
        last, nodes = nodes, scratch.save(grown.drop("segment", "name"))
        scratch.drop(last)
    return nodes


def blocked_shares(nodes: DataFrame) -> DataFrame:
    """host, template, blocked_share: blocked labels of all labels, smoothed towards what is hoped for."""
    sums = nodes.groupBy("host", "template").agg(
        F.sum("n").alias("n"), F.sum("allowed").alias("a"), F.sum("blocked").alias("b"), F.sum(F.col("n") * F.col("hope")).alias("g"))
    return sums.select("host", "template", ((F.col("b") + SMOOTH * F.col("g") / F.col("n")) / (F.col("a") + F.col("b") + SMOOTH)).alias("blocked_share"))


def filter_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, and the template and its smoothed share of blocked labels."""
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("rule_no", rule_index(F.col("host"), F.col("path")))
    label = _verdict(F.col("rule_no"))
    urls = scratch.save(rows.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count_if(label == "allow").alias("allowed"), F.count_if(label == "block").alias("blocked")))
    paths = urls.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("n", "allowed", "blocked")])
    whole = paths.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    prior = ((whole["b"] or 0) + 1) / ((whole["a"] or 0) + (whole["b"] or 0) + 2)
    everywhere = learn_templates(paths.select(F.lit("").alias("host"), "*", F.lit(prior).alias("hope")), scratch)
    hopes = _with(everywhere.select("host", "template", "path"), blocked_shares(everywhere), F.col("path"))
    nodes = learn_templates(urls.join(hopes.select("path", F.col("blocked_share").alias("hope")), "path"), scratch)
    known = _with(nodes.select("host", "path", "template"), blocked_shares(nodes), F.col("path"))
    out = rows.join(known, ["host", "path"], "left")
    learned = F.when(F.col("blocked_share") >= PURITY, "block").otherwise("allow")
    return out.select(
        "page_id", "host", "path", F.get(F.array(*[F.lit(r[0]) for r in RULES]), F.col("rule_no")).alias("rule"),
        F.coalesce(_verdict(F.col("rule_no")), learned).alias("verdict"), "template", "blocked_share")


def op2_url_filter(pages: DataFrame) -> DataFrame:
    return filter_urls(pages)
