"""Lines, blocks, noise and windows over documents (doc_id, text). Windows are per document, never global."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Python's line ends: more than the newline.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
PAGE_MARKER = r"<!--\s*page:(\d+)\s*-->"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, pos, line``: one row for each line, without a last empty one."""
    split = F.split(T.text(text_col), LINE_END)
    kept = F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(kept).alias("pos", "line"))


def with_pages(rows: DataFrame) -> DataFrame:
    """Adds ``page``, the last marker's number; marker lines are flagged by ``is_marker``."""
    mark = F.regexp_extract("line", PAGE_MARKER, 1)
    before = W.partitionBy("doc_id").orderBy("pos")
    number = F.when(mark != "", mark.cast("int"))
    return rows.withColumn("is_marker", mark != "").withColumn("page", F.last(number, True).over(before))


def build_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, pos, block_id, text, page, section, element_type, char_count``: runs of lines as blocks.

    Page markers, blank lines and headings end a block; a heading is one of its own; fenced code is one block with its
    fences. The section is the last heading's text. Documents without text have no blocks.
    """
    order = W.partitionBy("doc_id").orderBy("pos")
    rows = with_pages(lines(docs, id_col, text_col)).withColumn("line", F.regexp_replace("line", r"(?U)\s+$", ""))
    fence = F.ltrim("line").startswith("```") & ~F.col("is_marker")
    rows = rows.withColumn("is_fence", fence).withColumn("fences", F.coalesce(F.sum(F.col("is_fence").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.col("fences") % 2 == 1
    kind = (
        F.when(F.col("is_marker"), "marker")
        .when(F.col("is_fence") & ~inside, "open")
        .when(inside, "code")
        .when(F.trim("line") == "", "blank")
        .when(T.element_type(F.col("line")) == "heading", "heading")
        .otherwise("text")
    )
    rows = rows.withColumn("kind", kind).withColumn("was", F.lag("kind").over(order))
    starts = F.col("kind").isin("open", "heading") | ((F.col("kind") == "text") & ~F.coalesce(F.col("was") == "text", F.lit(False))) | ((F.col("kind") == "code") & ~F.coalesce(F.col("was").isin("open", "code"), F.lit(False)))
    rows = rows.withColumn("island", F.sum(starts.cast("int")).over(order)).where(~F.col("kind").isin("marker", "blank"))
    merged = rows.groupBy("doc_id", "island").agg(F.min("pos").alias("first"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("body"), F.max(F.col("kind").isin("open", "code")).alias("fenced"), F.first("page", True).alias("page"))
    value = F.regexp_replace(F.array_join(F.transform("body", lambda x: x["line"]), "\n"), r"^(?U)\s+|(?U)\s+$", "")
    merged = merged.withColumn("text", value).where("text <> ''").withColumn("element_type", T.element_type(F.col("text"), F.col("fenced")))
    at = W.partitionBy("doc_id").orderBy("island")
    heading = F.when((F.col("element_type") == "heading"), F.trim(F.regexp_replace(F.substring_index("text", "\n", 1), r"^#{1,6}\s*", "")))
    out = merged.withColumn("pos", F.row_number().over(at)).withColumn("section", F.coalesce(F.last(heading, True).over(at), F.lit("")))
    return out.select("doc_id", "pos", F.format_string("block-%04d", "pos").alias("block_id"), "text", "page", "section", "element_type", F.length("text").alias("char_count"))


def repeated_lines(rows: DataFrame, group: str = "doc_id", part: str = "page", keep: int = 10, shortest: int = 16, longest: int = 140) -> DataFrame:
    """``group, line, n, rank``: lines of ``rows`` (line, pos) that occur in two or more parts of a group, most frequent first."""
    norm = rows.withColumn("line", T.collapse(F.col("line"))).where(F.length("line").between(shortest, longest) & ~F.col("line").rlike(r"^\d+$"))
    once = norm.groupBy(group, part, "line").agg(F.min("pos").alias("pos"))
    counts = once.groupBy(group, "line").agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n >= 2")
    best = W.partitionBy(group).orderBy(F.desc("n"), "first", "line")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep).select(group, "line", "n", "rank")


def frequent_lines(rows: DataFrame, keep: int = 100, shortest: int = 16, longest: int = 140) -> DataFrame:
    """``line, n_docs, place``: the lines that most documents share, two at least, over the whole corpus."""
    norm = rows.select("doc_id", T.collapse(F.col("line")).alias("line"))
    once = norm.where(F.length("line").between(shortest, longest) & ~F.col("line").rlike(r"^\d+$")).distinct()
    counts = once.groupBy("line").agg(F.count("*").alias("n_docs")).where("n_docs >= 2")
    top = counts.orderBy(F.desc("n_docs"), "line").limit(keep)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("n_docs"), "line")).cast("long"))


def split_noise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Kept text (doc_id, text) and noise (doc_id, metadata_id, page, noise_reason, text, char_count)."""
    rows = with_pages(lines(docs, id_col, text_col)).withColumn("_c", T.collapse(F.col("line")))
    repeated = repeated_lines(rows.where(~F.col("is_marker")).withColumn("page", F.coalesce("page", F.lit(0)))).select(F.col("doc_id").alias("_d"), F.col("line").alias("_l"))
    seen = rows.join(repeated, (F.col("doc_id") == F.col("_d")) & (F.col("_c") == F.col("_l")), "left")
    judged = seen.withColumn("noise_reason", F.when(F.col("is_marker"), "").otherwise(T.noise_reason(F.col("_c"), F.col("_l").isNotNull(), collapsed=True)))
    body = judged.where("noise_reason = ''").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("b"))
    joined = F.regexp_replace(F.array_join(F.transform("b", lambda x: x["line"]), "\n"), r"\n{4,}", "\n\n\n")
    order = W.partitionBy("doc_id").orderBy("pos")
    noise = judged.where("noise_reason <> ''").withColumn("n", F.row_number().over(order)).withColumn("text", F.col("_c"))
    return body.select("doc_id", T.strip(joined).alias("text")), noise.select("doc_id", F.format_string("metadata-%04d", "n").alias("metadata_id"), "page", "noise_reason", "text", F.length("text").alias("char_count"))


def sections(blocks: DataFrame, limit: int = 180) -> DataFrame:
    """``doc_id, section, block_ids, pages, char_count, excerpt`` from blocks."""
    own = F.sort_array(F.collect_list(F.struct("pos", "block_id", "text")))
    out = blocks.groupBy("doc_id", "section").agg(own.alias("b"), F.array_sort(F.collect_set("page")).alias("pages"), F.sum("char_count").alias("char_count"))
    return out.select("doc_id", "section", F.transform("b", lambda x: x["block_id"]).alias("block_ids"), "pages", "char_count", T.excerpt(F.element_at("b", 1)["text"], limit).alias("excerpt"))


def neighbours(rows: DataFrame, group: str, order: str, of: str) -> DataFrame:
    w = W.partitionBy(group).orderBy(order)
    return rows.withColumn("previous", F.lag(of).over(w)).withColumn("next", F.lead(of).over(w))


def tumbling_windows(rows: DataFrame, group: str, order: list[str | Column], ok: Column, missing: Column, size: int = 20) -> DataFrame:
    """``group, window, n, ok, missing, ratio, blocking`` over windows of ``size`` rows in order."""
    at = F.floor((F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1) / size).cast("long")
    out = rows.select(F.col(group), at.alias("window"), ok.cast("int").alias("_ok"), missing.cast("int").alias("_missing"))
    out = out.groupBy(group, "window").agg(F.count("*").alias("n"), F.sum("_ok").alias("ok"), F.sum("_missing").alias("missing"))
    return out.withColumn("ratio", F.round(F.col("ok") / F.col("n"), 3)).withColumn("blocking", F.col("missing") > F.greatest(F.lit(2), F.floor(F.col("n") * 0.03)))


def coverage_by_page(expected: DataFrame, seen: DataFrame, keys: list[str], id_col: str, status: str = "status") -> DataFrame:
    """Per page: expected, missing, duplicated and errored ids, and coverage; both sides are aggregated before they meet."""
    have = seen.groupBy(*keys, id_col).agg(F.count("*").alias("times"), F.max((F.col(status) != "ok").cast("int")).alias("bad"))
    met = expected.select(*keys, id_col).distinct().join(have, [*keys, id_col], "left")
    missing, bad = F.col("times").isNull(), F.coalesce(F.col("bad") > 0, F.lit(False))
    out = met.groupBy(*keys).agg(F.count("*").alias("expected"), F.count_if(missing).alias("missing"), F.count_if(F.col("times") > 1).alias("duplicated"), F.count_if(bad).alias("errored"))
    covered = F.col("expected") - F.col("missing") - F.col("errored")
    return out.withColumn("coverage", F.round(covered / F.col("expected"), 3)).withColumn("status", F.when(F.col("missing") + F.col("errored") > 0, "warn").otherwise("ok"))


def page_tails(blocks: DataFrame, chars: int = 80, anchors: int = 3) -> DataFrame:
    """``doc_id, page, tail, anchors``: the last characters of a page and the last years or long words in them."""
    joined = blocks.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("b"))
    whole = F.array_join(F.transform("b", lambda x: x["text"]), "\n")
    out = joined.select("doc_id", "page", F.right(T.collapse(whole), F.lit(chars)).alias("tail"))
    found = F.regexp_extract_all("tail", F.lit(r"(20\d{2}|[A-Za-z]{12,})"), 1)
    return out.withColumn("anchors", F.slice(found, F.greatest(F.lit(1), F.size(found) - anchors + 1), anchors))


def adjacent_best_match(left: DataFrame, right: DataFrame, key: str = "page", low: float = 0.28, accept: float = 0.55, least_chars: int = 500) -> DataFrame:
    """Token Jaccard of each page with the same page and its neighbours: ``page, same, best, best_page, status``.

    The neighbour join is an equi-join: each left page is sent to the three pages it may match.
    """
    a = left.select(F.col(key).alias("page"), T.drift_tokens(F.col("text")).alias("ta"), F.length("text").alias("la"))
    b = right.select(F.col(key).alias("other"), T.drift_tokens(F.col("text")).alias("tb"), F.length("text").alias("lb"))
    near = a.withColumn("other", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1))).join(b, "other", "left").where("tb is not null")
    scored = near.withColumn("score", F.round(T.jaccard(F.col("ta"), F.col("tb")), 3))
    own = F.col("other") == F.col("page")
    out = scored.groupBy("page").agg(F.max(F.when(own, F.col("score"))).alias("same"), F.max("score").alias("best"), F.max_by("other", F.struct("score", -F.col("other"))).alias("best_page"), F.max(F.when(own, F.least("la", "lb"))).alias("chars"))
    warn = (F.col("chars") >= least_chars) & (F.col("same") < low) & ~((F.col("best_page") != F.col("page")) & (F.col("best") >= accept))
    return out.withColumn("status", F.when(warn, "warn").otherwise("ok")).drop("chars")


def running_mode(rows: DataFrame, group: str, order: str, on: Column, off: Column) -> DataFrame:
    """Adds ``mode``: whether ``on`` came last before this row, and not ``off``."""
    switch = F.when(on, True).when(off, False)
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("mode", F.coalesce(F.last(switch, True).over(w), F.lit(False)))


def reference_tail(rows: DataFrame, headings: tuple[str, ...] = ("references", "bibliography"), ignored: tuple[str, ...] = ()) -> DataFrame:
    """Lines after the first exact references heading, without ignored ones and bare dates."""
    body = F.lower(F.trim("line"))
    start = rows.where(body.isin(*headings)).groupBy("doc_id").agg(F.min("pos").alias("_from"))
    after = rows.join(start, "doc_id").where(F.col("pos") > F.col("_from")).drop("_from")
    return after.where(~body.isin(*ignored, "") & ~F.col("line").rlike(r"^\s*\d{1,2}[/.]\d{1,2}[/.]\d{2,4}"))


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """``doc_id, text``: blocks in order with their markers, failed ones as a placeholder."""
    part = F.concat(F.lit("<!-- "), F.col("block_id"), F.lit(" -->\n"), F.when(F.col("status") == "ok", T.text("translation")).otherwise(F.lit("[untranslated]")))
    out = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", part.alias("part")))).alias("b"))
    return out.select("doc_id", F.array_join(F.transform("b", lambda x: x["part"]), "\n\n").alias("text"))


def line_order_signature(spans: DataFrame) -> DataFrame:
    return spans.select("doc_id", "page", "line_index", F.substring("text", 1, 40).alias("head")).orderBy("doc_id", "page", "line_index")


def extraction_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_token: int = 18) -> DataFrame:
    """One row for each document: token counts and lengths, breaks, noise, and a status by fixed limits."""
    body = T.text(text_col)
    # Token sizes are a column of their own, as several figures are made from them.
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("_t"), F.transform(T.alpha_tokens(F.col(text_col)), F.length).alias("_n"))
    metadata = F.filter(F.split("_t", LINE_END), lambda x: (F.length(F.trim(x)) >= 20) & T.metadata_line(x))
    out = rows.select(
        "doc_id",
        F.size("_n").alias("n_tokens"),
        F.coalesce(F.array_max("_n"), F.lit(0)).alias("longest"),
        F.when(F.size("_n") > 0, T.round_half(F.aggregate("_n", F.lit(0), lambda a, x: a + x) / F.size("_n"), 2)).otherwise(0.0).alias("average"),
        F.size(F.filter("_n", lambda n: n >= long_token)).alias("n_long"),
        F.regexp_count("_t", F.lit(r"[A-Za-z]-\n[A-Za-z]")).alias("n_breaks"),
        F.size(metadata).alias("n_metadata"),
    )
    warn = (F.col("n_long") >= 5) | (F.col("longest") >= 35) | (F.col("n_metadata") >= 8)
    return out.withColumn("status", F.when(warn, "warn").otherwise("ok"))
