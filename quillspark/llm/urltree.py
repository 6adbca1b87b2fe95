"""URL filtering by rules and, where no rule fits, by a tree of path templates for each host.

Paths become templates: digits, long hexadecimal and other id-like segments turn into wildcards, and where a node of a
host's tree still has more than ``MAX_CHILDREN`` children, these turn into one wildcard too. Pages that a rule judges
are labelled ones, and so are those that a table of labels names. Branches under one parent that are statistically alike, that is,
whose share of allowed pages is within ``Z`` standard errors of their siblings' pooled share, are merged into one. A
template's purity is its share of allowed among labelled pages, smoothed towards its parent's, and so on up to the
host's and the whole table's; templates below ``REJECT_BELOW`` are blocked.

Counts are aggregated by host and template before anything else moves, so a host that holds a third of all pages costs
as much as any other. All of it is DataFrame code.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Verdict, and host with path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DEPTH, MAX_CHILDREN = 4, 32
Z, SMOOTHING, REJECT_BELOW = 2.0, 8.0, 0.35


def host_of(url: Column) -> Column:
    rest = F.expr("substring(_url, locate('://', _url) + 3)")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*+", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.when(url.contains("://"), host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.expr("substring(_url, locate('://', _url) + 3)")
    return F.when(url.contains("://"), F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)).otherwise("")


def rule_for(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tried first, as it wraps the rest
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit("/" + path))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def template_of(path: Column) -> Column:
    """The first ``DEPTH`` segments with id-like ones generalised; deeper ones are one wildcard."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    s = F.transform(segments, lambda s: F.when(s.rlike(r"^[0-9]++$"), "{n}").when(s.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}+$"), "{id}").when(F.length(s) > 40, "{slug}").otherwise(F.regexp_replace(s, r"[0-9]++", "{n}")))
    return F.when(F.size(s) > DEPTH, F.concat(F.slice(s, 1, DEPTH - 1), F.array(F.lit("**")))).otherwise(s)


def _generalised(counts: DataFrame) -> DataFrame:
    """``host, raw, template, good, bad``: children turned into a wildcard where a node has too many, from the root down."""
    now = counts.withColumn("template", F.col("raw"))
    for depth in range(1, DEPTH + 1):
        parent = F.slice("template", 1, depth - 1)
        here = now.where(F.size("template") >= depth).groupBy("host", parent.alias("parent")).agg(F.approx_count_distinct(F.get("template", F.lit(depth - 1)), 0.02).alias("children"))
        wide = here.where(F.col("children") > MAX_CHILDREN).select(F.col("host").alias("_h"), F.col("parent").alias("_p"))
        met = now.join(wide, (F.col("host") == F.col("_h")) & (parent == F.col("_p")) & (F.size("template") >= depth), "left")
        star = F.concat(parent, F.array(F.lit("*")), F.slice("template", depth + 1, DEPTH))
        now = met.withColumn("template", F.when(F.col("_h").isNotNull(), star).otherwise(F.col("template"))).drop("_h", "_p")
    return now


def purities(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """``host, raw, branch, purity`` for each row of ``counts`` (host, raw: array of segments, good, bad)."""
    nodes = materialize(spark, _generalised(counts), "templates")
    overall = nodes.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    g, b = int(overall["g"] or 0), int(overall["b"] or 0)
    prior = (g + 1) / (g + b + 1) if g + b else 1.0
    by_host = nodes.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("bad").alias("hb"))
    level = by_host.select(F.col("host").alias("_h"), F.expr("cast(array() as array<string>)").alias("_b"), ((F.col("hg") + SMOOTHING * F.lit(prior)) / (F.col("hg") + F.col("hb") + SMOOTHING)).alias("_q"))
    now = nodes.withColumn("branch", F.expr("cast(array() as array<string>)")).join(level, F.col("host") == F.col("_h")).drop("_h", "_b").withColumnRenamed("_q", "purity")
    for depth in range(1, DEPTH + 1):
        there = F.size("template") >= depth
        here = now.where(there).groupBy("host", "branch", F.get("template", F.lit(depth - 1)).alias("seg")).agg(F.sum("good").alias("sg"), F.sum("bad").alias("sb"), F.first("purity").alias("above"))
        siblings = W.partitionBy("host", "branch")
        rest_g, rest_n = F.sum("sg").over(siblings) - F.col("sg"), F.sum(F.col("sg") + F.col("sb")).over(siblings) - F.col("sg") - F.col("sb")
        n = F.col("sg") + F.col("sb")
        pooled = F.when(n + rest_n > 0, (F.col("sg") + rest_g) / (n + rest_n))
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(n, F.lit(1)) + 1 / F.greatest(rest_n, F.lit(1))))
        alike = (n == 0) | (rest_n == 0) | (F.abs(F.col("sg") / F.greatest(n, F.lit(1)) - rest_g / F.greatest(rest_n, F.lit(1))) <= Z * error)
        here = here.withColumn("kept", F.when(F.coalesce(alike, F.lit(True)), F.lit("~")).otherwise(F.col("seg")))
        merged = here.groupBy("host", "branch", "kept").agg(F.sum("sg").alias("mg"), F.sum("sb").alias("mb"), F.first("above").alias("above"))
        merged = merged.withColumn("_q", (F.col("mg") + SMOOTHING * F.col("above")) / (F.col("mg") + F.col("mb") + SMOOTHING))
        named = here.select("host", "branch", "seg", "kept").join(merged.select("host", "branch", "kept", "_q"), ["host", "branch", "kept"]).select(F.col("host").alias("_h"), F.col("branch").alias("_b"), F.col("seg").alias("_s"), F.col("kept").alias("_k"), "_q")
        met = now.join(named, (F.col("host") == F.col("_h")) & (F.col("branch") == F.col("_b")) & (F.get("template", F.lit(depth - 1)) == F.col("_s")), "left")
        now = met.select("host", "raw", "template", "good", "bad", F.when(F.col("_k").isNotNull(), F.concat("branch", F.array("_k"))).otherwise(F.col("branch")).alias("branch"), F.coalesce("_q", "purity").alias("purity"))
        now = materialize(spark, now, f"tree{depth}")
    return now.select("host", "raw", "branch", "purity")


def filter_urls(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, reject_below: float = REJECT_BELOW, labels: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, purity``, one row for each row of ``pages``.

    ``labels`` (page_id, good: boolean) adds to what rules tell of templates; a rule comes first where a page has both,
    and of several labels of a page any good one counts. A label doesn't judge its page, only its template.

    Null urls and urls without ``://`` have empty host and path, fit no rule, and share the template of the empty host.
    The longest fitting rule decides; otherwise a template whose smoothed purity is below ``reject_below`` is blocked.
    Without labelled pages everything else is allowed. Repeated rows count as often as they occur and give equal rows.
    Other columns are ignored, whatever their names.
    """
    url = F.col("_url")
    seen = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("_url"))
    seen = seen.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_for(rules)
    seen = materialize(spark, seen.withColumns({"rule": name, "judged": verdict, "raw": template_of(F.col("path"))}), "urls")
    good = F.col("judged") == "allow"
    marked = seen
    if labels is not None:
        told = labels.where(F.col("good").isNotNull()).groupBy(F.col("page_id").alias("_page")).agg(F.max("good").alias("_good"))
        marked, good = seen.join(told, F.col("page_id") == F.col("_page"), "left"), F.coalesce(good, F.col("_good"))
    counts = marked.groupBy("host", "raw").agg(F.sum(good.cast("long")).alias("good"), F.sum((~good).cast("long")).alias("bad"))
    counts = counts.na.fill(0, ["good", "bad"])
    tree = purities(spark, counts).select(F.col("host").alias("_h"), F.col("raw").alias("_r"), "purity")
    out = seen.join(tree, (F.col("host") == F.col("_h")) & (F.col("raw") == F.col("_r")), "left")
    method = F.when(F.coalesce("purity", F.lit(1.0)) < reject_below, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("judged", method).alias("verdict"), "purity")
