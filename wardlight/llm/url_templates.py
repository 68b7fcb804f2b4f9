"""Operator 6: URL rules, and a path-template tree for what they leave open.

Rules name a host and a path prefix; the longest that fits decides. Pages they decide are the labels
of the tree. Per host, path segments are generalised from the root on: runs of digits and long
hexadecimal names become wildcards; sibling branches that have labels and too few pages, or a share
of blocked pages that does not differ significantly from their node's, are merged into the branch
``*``, and those of few pages and no labels into ``<few>``. A template is rejected when the smoothed
share of blocked pages among its labelled ones, (blocked + weight * prior) / (labelled + weight),
reaches the threshold; a template without labelled pages keeps the prior and is allowed.

The tree works on one row per distinct generalised path, counted before any exchange by host, so a
host with a third of all pages is as many rows as it has distinct paths. Each level of the tree is
written before the next one is named, so a level's plan does not grow with the depth.

Cases: a null url or one without ``://`` has an empty host and path (one template of its own); paths
deeper than max_depth keep the rest as one wildcard segment; repeated rows count as often as they
occur; without labels everything unmatched is allowed; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.session import checkpoint_root

MAX_DEPTH = 8
MIN_PAGES = 5
CHI_SQUARE = 3.84          # one degree of freedom, 5 %
PRIOR_WEIGHT = 4.0
PRIOR = 0.25
THRESHOLD = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest of ``rules`` (text like ``net/es/``, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, prefix = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + prefix))
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _segments(path: Column, max_depth: int) -> Column:
    """Segments after the first slash, with digit runs and long hexadecimal names as wildcards."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    shaped = F.transform(parts, lambda s: F.when(s.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("<hex>"))
                         .otherwise(F.regexp_replace(s, "[0-9]+", "<n>")))
    return F.when(F.size(shaped) > max_depth, F.concat(F.slice(shaped, 1, max_depth - 1), F.array(F.lit("**")))).otherwise(shaped)


def path_templates(paths: DataFrame, min_pages: int, weight: float, prior: float) -> DataFrame:
    """``paths`` (host, segments, pages, labelled, blocked), one row per distinct path -> host,
    segments, template, purity."""
    checkpoint_root(paths.sparkSession)
    paths = paths.withColumn("template", F.lit("")).checkpoint()
    depth = paths.agg(F.max(F.size("segments"))).first()[0] or 0
    counts = [F.sum(c).alias(c) for c in ("pages", "labelled", "blocked")]
    for level in range(depth):
        at = paths.withColumn("segment", F.get("segments", F.lit(level)))
        child = at.where("segment is not null").groupBy("host", "template", "segment").agg(*counts)
        node = child.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
        share = F.try_divide("b", "n")
        gap = F.col("blocked") - F.col("labelled") * share
        differs = gap * gap > CHI_SQUARE * F.col("labelled") * share * (1 - share)
        common = F.col("pages") >= min_pages
        name = F.when(common & ((F.col("labelled") == 0) | differs), F.col("segment")) \
            .otherwise(F.when(F.col("labelled") == 0, F.lit("<few>")).otherwise(F.lit("*")))
        names = child.join(node, ["host", "template"]).select(
            "host", "template", "segment", name.alias("name"))
        paths = at.join(names, ["host", "template", "segment"], "left").select(
            "host", "segments", "pages", "labelled", "blocked",
            F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name")).alias("template")).checkpoint()
    purity = (F.sum("blocked") + F.lit(weight * prior)) / (F.sum("labelled") + F.lit(weight))
    return paths.join(paths.groupBy("host", "template").agg(purity.alias("purity")), ["host", "template"]) \
        .select("host", "segments", "template", "purity")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], max_depth: int = MAX_DEPTH, min_pages: int = MIN_PAGES,
                weight: float = PRIOR_WEIGHT, prior: float = PRIOR, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules)) \
        .withColumn("segments", _segments(F.col("path"), max_depth))
    paths = rows.groupBy("host", "segments").agg(
        F.count("*").alias("pages"), F.count("hit").alias("labelled"),
        F.coalesce(F.sum((F.col("hit.verdict") == "block").cast("long")), F.lit(0)).alias("blocked"))
    found = path_templates(paths, min_pages, weight, prior)
    judged = F.when(F.col("purity") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(found, ["host", "segments"]).select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", judged).alias("verdict"), "template", "purity")
