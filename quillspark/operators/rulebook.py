"""Rules over the lines and text of pages, as rows: what a translated page must not show.

Engines are ``line_rules`` and ``rewrites.page_rules``; rules for one report's layout are rows like any other. Pages are
doc_id, page, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import small

LINE_SCHEMA = "rule string, least int, most int, pattern string, also string, cjk boolean, outside_references boolean"
_HEADER, _METADATA = r"HUMA|NITIES AND SOCIAL SCIENCES|HUMANITIES AND SOCIAL SCIENCES\s+通讯|HUMANITIES AND SOCIAL SCIENCES 通讯版块", r"(?i)(?:\bHUMA\b|HUMANITIES|polyu\.edu|stanford\.ed\s+u|doi\.org|s41599)"
_CHART = r"(?i)\b(?:Figure\s+\d+(?:\.\d+)*|By National Affiliation|Number of notable AI models|by (?:select )?geographic areas?|by organization|by sector)\b"
_CHART_ALSO = r"(?i)[一-鿿]|\b(?:Figure|By National Affiliation|Number of notable AI models)\b"
_AXIS = r"(?i)\b(?:Number of notable AI models|Notable AI models \(% of total\))\b"
# Rule, least and most characters of a line, what it must show, what it must show as well, whether it must
# show CJK too, and whether only outside references.
LINE_RULES = (
    ("running_header_not_normalized", 0, 100, _HEADER, "", True, False),
    ("header_footer_fragmented", 0, 100, _HEADER, "", True, False),
    ("visible_style_tag_leak", 0, None, r"(?i)</?style\b", "", False, False),
    ("table_header_untranslated", 0, None, r"\bNumber of texts\b", "", False, False),
    ("table_caption_untranslated", 0, None, r"(?i)^Table\s+\d+\b", "", False, False),
    ("metadata_mixed_language", 0, 140, _METADATA, "", True, True),
    ("metadata_paint_mixed_language", 0, 140, _METADATA, "", True, True),
    ("metadata_original_layer_unsuppressed", 0, 140, _METADATA, "", True, True),
    ("chart_label_untranslated", 0, 180, _CHART, _CHART_ALSO, False, False),
    ("chart_label_partial_translation", 0, 180, _CHART, _CHART_ALSO, False, False),
    ("chart_label_writeback_failed", 0, 180, _CHART, _AXIS, False, False),
    ("chart_axis_original_text_visible", 0, 180, _CHART, _AXIS, False, False),
    ("body_prose_partial_direct_output", 80, None, r"(?i)\b(?:This chapter focuses|The next chapter|reviews the technical performance)\b", "", True, False),
    ("example_block_translated", 0, None, r"LLM-[A-Za-z0-9-]+\s*[:：]\s*[一-鿿]", "", False, False),
)
# Lines that are headings left in the source's language.
HEADINGS_LEFT = (
    "contents", "introduction", "literature review", "methods", "references", "chair", "co-chair", "members", "organizations", "chapter highlights", "contributors", "overview", "notable ai models", "top takeaways",
    "message from the co-chairs", "steering committee", "research and development", "by sector and organization", "by national affiliation", "discussion", "conclusion", "data availability", "notes",
    "author contributions", "competing interests", "ethics approval", "informed consent", "additional information", "supplementary information",
)
# Rules over a page's whole text: what must match, of which of these at least how many, and what must not.
PAGE_RULES = (
    ("contact_email_fragmented", (), (r"(?i)[A-Za-z0-9_.%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{1,3}\s+(?:u|ed|hk)\b", r"(?i)@\s*\n|@\s*$|\bpolyu\.edu\.\s+hk\b|\bstanford\.ed\s+u\b"), 1, ()),
    ("table_rule_loss", (r"(?i)(?:表\s*\d+|Table\s*\d+)", r"(?s)__+[^_].*?__+"), (), 0, ()),
    ("person_name_duplicate_translation", (r"([一-鿿·]{2,})（\1（[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)+））",), (), 0, ()),
    ("orphan_drop_cap", (r"(?m)^T$", r"(?im)^(?:introduction|引言)$"), (), 0, ()),
    ("affiliation_footer_fragmented", (r"(?i)Hong Kong Polytechnic\s+中国香港|polyu\.edu\.hk",), (), 0, ("香港理工大学",)),
    ("metadata_cluster_fragmented", (r"(?i)Hong Kong Polytechnic\s+中国香港|polyu\.edu\.hk",), (), 0, ("香港理工大学",)),
    ("chapter_index_merge", (r"(?i)\b(?:Technical Performance|Responsible AI|Economy|Science|Medicine|Education)\b", r"(?i)AI Index|人工智能指数|Chapter Highlights|章节要点|Research and Development|研究与开发|Responsible AI|负责任的人工智能", "[一-鿿]"), (), 0, ()),
    ("toc_row_renderer_failed", (r"(?i)\b(?:Technical Performance|Responsible AI|Economy|Science|Medicine|Education)\b", r"(?i)AI Index|人工智能指数|Chapter Highlights|章节要点|Research and Development|研究与开发|Responsible AI|负责任的人工智能", "[一-鿿]"), (), 0, ()),
)
# Headers and captions of tables and their translations, told apart by what is wrong if they still show.
TABLE_TEXTS = (("header", "Sub-corpus", "子语料库"), ("header", "Number of texts", "文本数量"), ("header", "Tokens", "词元数"), ("header", "Mean length", "平均长度"), ("caption", "Table 1", "表 1"), ("caption", "Table 2", "表 2"))


def line_rule_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LINE_RULES), LINE_SCHEMA)


def page_rule_rows(spark: SparkSession) -> DataFrame:
    rows = [(r, "warn", list(a), list(b), n, list(x)) for r, a, b, n, x in PAGE_RULES]
    return spark.createDataFrame(rows, "rule string, severity string, all_of array<string>, any_of array<string>, least int, none_of array<string>")


def page_lines(pages: DataFrame) -> DataFrame:
    """``doc_id, page, text, line``: lines that aren't blank, white space collapsed."""
    lines = F.filter(F.transform(F.split(T.text("text"), "\n"), T.collapse), lambda x: x != "")
    return pages.select("doc_id", "page", "text", F.explode(lines).alias("line"))


def references_shown(c: Column) -> Column:
    """Whether a page has a references heading with text below it, or looks like a list of references."""
    return T.text(c).rlike(r"(?im)^\s*(?:references|参考文献)\s*[:：]?\s*$[\s\S]*\S") | T.reference_page(c)


def preserved_metadata(line: Column) -> Column:
    """Metadata lines that are right as they are: whole addresses with their institution, and untranslated headers."""
    email = line.rlike(r"[A-Za-z0-9_.%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}") & ~line.rlike(r"(?i)@\s*$|@\s+|\.ed\s+u\b|\.edu\.\s+hk\b")
    named = line.rlike("香港理工大学|Hong Kong Polytechnic University|邮箱") | F.lower(line).contains("email")
    return (email & named) | (line.rlike(r"(?i)^(?:HUMANITIES\s+AND\s+SOCIAL\s+SCIENCES\s+COMMUNICATIONS\b|https://doi\.org/10\.1057/s41599)") & ~T.has_cjk(line))


def line_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``doc_id, page, rule, n``: lines of a page that meet a rule (``LINE_SCHEMA``)."""
    told = page_lines(pages).withColumn("_refs", references_shown(F.col("text"))).withColumn("_kept", preserved_metadata(F.col("line"))).drop("text")
    n = F.length("line")
    ok = (n >= F.coalesce("least", F.lit(0))) & (F.col("most").isNull() | (n <= F.col("most"))) & F.regexp_like("line", F.col("pattern")) & ((F.col("also") == "") | F.regexp_like("line", F.col("also"))) & (~F.col("cjk") | T.has_cjk(F.col("line"))) & (~F.col("outside_references") | ~(F.col("_refs") | F.col("_kept")))
    return told.join(small(rules), ok).groupBy("doc_id", "page", "rule").agg(F.count("*").alias("n"))


def headings_left(pages: DataFrame) -> DataFrame:
    """``doc_id, page, n``: headings of the source's language on pages of the translation."""
    return page_lines(pages).where(F.lower("line").isin(*HEADINGS_LEFT)).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


def reference_faults(pages: DataFrame) -> DataFrame:
    """``doc_id, page, rule``: references that were translated, or run together."""
    tail = F.regexp_extract(T.text("text"), r"(?im)^\s*(?:references|参考文献)\s*[:：]?\s*$([\s\S]*)", 1)
    t = pages.select("doc_id", "page", "text", tail.alias("_t")).where(F.trim("_t") != "")
    years = F.regexp_count("_t", F.lit(r"(?:19|20)\d{2}"))
    longest = F.array_max(F.transform(F.split("text", "\n"), lambda x: F.length(T.collapse(x))))
    found = F.array(F.when((T.cjk_count(F.col("_t")) >= 10) & (years >= 2), F.lit("references_body_translated")), F.when((years >= 4) & (longest >= 360), F.lit("references_entries_merged")))
    return t.select("doc_id", "page", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("rule"))


def dropped_table_texts(pages: DataFrame, tracked: DataFrame) -> DataFrame:
    """``doc_id, page, rule, evidence``: table headers and captions that still show on a page (doc_id, page, text).

    If the tracked paragraphs (doc_id, text) hold one or its translation, writing it back failed; else it never got there.
    """
    spark = pages.sparkSession
    texts = F.broadcast(spark.createDataFrame(list(TABLE_TEXTS), "kind string, source string, target string"))
    whole = lambda c: F.regexp_like(c, F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}_])\Q"), F.col("source"), F.lit(r"\E(?![\p{L}\p{N}_])")))
    shown = pages.join(texts, whole(T.text("text"))).select("doc_id", "page", "kind", "source")
    held = tracked.join(texts, whole(T.text("text")) | T.text("text").contains(F.col("target"))).select("doc_id", "source").distinct().withColumn("_held", F.lit(True))
    met = shown.join(held, ["doc_id", "source"], "left")
    ending = F.when(F.col("_held"), "writeback_failed").when(F.col("kind") == "header", "missing_from_il").otherwise("missing")
    return met.select("doc_id", "page", F.concat(F.lit("table_"), "kind", F.lit("_"), ending).alias("rule"), F.col("source").alias("evidence"))


def compact_label_kind(c: Column) -> Column:
    """allowed, neutral or residual: what a short label on a page may be."""
    s = T.strip(c)
    allowed = s.contains("@") | s.contains("://") | F.lower(s).startswith("doi") | F.lower(s).startswith("http") | s.rlike(r"^\d+(?:\.\d+)?%?$") | s.rlike(r"^[A-Za-z0-9_.%+-]+\.[A-Za-z]{2,}(?:\.[A-Za-z]{2,})?$") | s.rlike(r"^(?:AI|ML|NLP|GPU|CPU|API|LLM|GPT|R&D|EU|US|UK|OECD|UN|GDP|STEM)$") | s.rlike(r"^(?:OpenAI|GPT|ChatGPT)\s+o?\d+[A-Za-z]*$")
    neutral = s.rlike(r"^[A-Z][A-Za-z'’.-]{1,24}$") | (s.rlike(r"(?i)\bvs\.?\b") & s.rlike(r"(?i)\b(?:HT|MT|NMT|LLM|GPT|AI)\b"))
    return F.when((s != "") & allowed, "allowed").when((s != "") & neutral, "neutral").otherwise("residual")


def semantic_findings(pages: DataFrame) -> DataFrame:
    """``doc_id, page, rule``: all rules of this module over pages, once each."""
    from .rewrites import page_rules

    spark = pages.sparkSession
    parts = [line_rules(pages, line_rule_rows(spark)).select("doc_id", "page", "rule"), page_rules(pages, page_rule_rows(spark)).select("doc_id", "page", "rule"), headings_left(pages).select("doc_id", "page", F.lit("section_heading_untranslated").alias("rule")), reference_faults(pages)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
