"""Positioned text: boxes are structs (x0, y0, x1, y1). Joins are within a document's page, so they are equi-joins with
interval predicates on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

PAGE = ["doc_id", "page"]


def area(b: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{b}.x1") - F.col(f"{b}.x0")) * F.greatest(F.lit(0.0), F.col(f"{b}.y1") - F.col(f"{b}.y0"))


def intersection(a: str, b: str) -> Column:
    w = F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0")
    h = F.least(f"{a}.y1", f"{b}.y1") - F.greatest(f"{a}.y0", f"{b}.y0")
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def overlaps(spans: DataFrame, threshold: float = 0.55) -> DataFrame:
    """``doc_id, page, a, b, share``: pairs of spans (span_id, bbox) whose intersection covers that share of the smaller."""
    a = spans.select(*PAGE, F.col("span_id").alias("a"), F.col("bbox").alias("ba"))
    b = spans.select(*PAGE, F.col("span_id").alias("b"), F.col("bbox").alias("bb"))
    met = a.join(b, PAGE).where("a < b and ba.x0 < bb.x1 and bb.x0 < ba.x1 and ba.y0 < bb.y1 and bb.y0 < ba.y1")
    share = intersection("ba", "bb") / F.least(area("ba"), area("bb"))
    return met.withColumn("share", F.round(share, 3)).where(share >= threshold).select(*PAGE, "a", "b", "share")


def overlapping_count(spans: DataFrame, threshold: float = 0.55) -> DataFrame:
    return overlaps(spans, threshold).groupBy(*PAGE).agg(F.count_distinct("a").alias("n"))


def nearest(source: DataFrame, target: DataFrame) -> DataFrame:
    """Best target span for each source span (span_id, bbox, size): near, and of like size; with ``regressed``."""
    s = source.select(*PAGE, F.col("span_id").alias("s"), F.col("bbox").alias("sb"), F.col("size").alias("ss"))
    t = target.select(*PAGE, F.col("span_id").alias("t"), F.col("bbox").alias("tb"), F.col("size").alias("ts"))
    dy, dx = F.abs(F.col("sb.y0") - F.col("tb.y0")), F.abs(F.col("sb.x0") - F.col("tb.x0"))
    cost = 4 * dy + dx + 2 * F.abs(F.col("ss") - F.col("ts")) + 8 * F.greatest(F.lit(0.0), 0.86 * F.col("ss") - F.col("ts"))
    best = s.join(t, PAGE).groupBy(*PAGE, "s", "ss").agg(F.min_by(F.struct("t", "ts"), F.struct(cost, F.col("t"))).alias("m"))
    small = (F.col("ss") >= 8.5) & (F.col("m.ts") < 0.86 * F.col("ss")) & ~((F.col("ss") >= 24) & (F.col("m.ts") >= 0.75 * F.col("ss")))
    return best.select(*PAGE, "s", F.col("m.t").alias("t"), small.alias("regressed"))


def unpaired_numbers(lines: DataFrame, band: float = 8.5, side: float = 0.55) -> DataFrame:
    """Page numbers at the right of a page without a title line in their band of y."""
    number = F.trim("text").rlike(r"^\d{1,3}$") & (F.col("bbox.x0") >= side * F.col("page_width"))
    titles = lines.where(~F.trim("text").rlike(r"^\d+$")).select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("bbox.y0").alias("_y"))
    return lines.where(number).join(titles, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & (F.abs(F.col("bbox.y0") - F.col("_y")) <= band), "left_anti")


def with_good_twin(spans: DataFrame, threshold: float, dx: float = 45, dy: float = 10) -> DataFrame:
    """Small spans that repeat, nearby, a span of the same text and at least the threshold's size."""
    big = spans.where(F.col("size") >= threshold).select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("text").alias("_t"), F.col("bbox").alias("_b"))
    near = (F.abs(F.col("bbox.x0") - F.col("_b.x0")) <= dx) & (F.abs(F.col("bbox.y0") - F.col("_b.y0")) <= dy)
    return spans.where(F.col("size") < threshold).join(big, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & (F.col("text") == F.col("_t")) & near, "left_semi")


def missing_captions(source: DataFrame, target: DataFrame, dy: float = 45) -> DataFrame:
    """Source captions without a target caption of the same number near the same height."""
    number = F.regexp_extract(T.text("text"), r"(?i)(?:figure|fig\.|table|图|表)\s*(\d+)", 1)
    s = source.withColumn("number", number).where("number <> ''")
    t = target.withColumn("_n", number).where("_n <> ''").select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), "_n", F.col("bbox.y0").alias("_y"))
    return s.join(t, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & (F.col("number") == F.col("_n")) & (F.abs(F.col("bbox.y0") - F.col("_y")) <= dy), "left_anti")


def reading_order(spans: DataFrame, split: float = 0.65) -> DataFrame:
    """Adds ``column`` and ``nth``, the place within it by height, then from the left."""
    column = (F.col("bbox.x0") >= split * F.col("page_width")).cast("int")
    out = spans.withColumn("column", column)
    return out.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "page", "column").orderBy(F.round("bbox.y0", 1), "bbox.x0")))


def toc_rows(spans: DataFrame) -> DataFrame:
    """``doc_id, page, column, number, title``: title fragments between one page number's height and the next's; of
    numbers at one height, the leftmost takes them, then the least."""
    rows = spans.withColumn("column", F.coalesce("column", F.lit(0)))
    numbers = rows.where(F.trim("text").rlike(r"^\d{1,3}$")).select("doc_id", "page", "column", F.trim("text").cast("int").alias("number"), F.col("bbox.y0").alias("y"), F.col("bbox.x0").alias("x"))
    w = W.partitionBy("doc_id", "page", "column").orderBy("y", "x", "number")
    numbers = numbers.withColumn("above", F.coalesce(F.lag("y").over(w), F.lit(float("-inf"))))
    parts = rows.where(~F.trim("text").rlike(r"^\d+$")).select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("column").alias("_c"), F.col("bbox.y0").alias("_y"), F.col("bbox.x0").alias("_x"), "text")
    met = numbers.join(parts, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & (F.col("column") == F.col("_c")) & (F.col("_y") > F.col("above") + 1) & (F.col("_y") <= F.col("y") + 1))
    out = met.groupBy("doc_id", "page", "column", "number", "y").agg(F.array_sort(F.collect_list(F.struct("_y", "_x", "text"))).alias("b"))
    return out.select("doc_id", "page", "column", "number", F.array_join(F.transform("b", lambda x: F.trim(x["text"])), " ").alias("title"))


def typography(spans: DataFrame) -> DataFrame:
    """Per page: sizes, their histogram, and the share of the most common colour."""
    s = F.col("size")
    out = spans.groupBy(*PAGE).agg(F.count("*").alias("n"), F.min(s).alias("smallest"), F.max(s).alias("largest"), F.round(F.avg(s), 2).alias("average"), F.count_if(s < 6).alias("under_6"), F.count_if((s >= 6) & (s < 8)).alias("to_8"), F.count_if((s >= 8) & (s < 14)).alias("to_14"), F.count_if(s >= 14).alias("over_14"))
    colours = spans.groupBy(*PAGE, "color").agg(F.count("*").alias("c"))
    top = colours.groupBy(*PAGE).agg(F.max_by(F.struct("color", "c"), F.struct("c", -F.col("color"))).alias("t"))
    return out.join(top, PAGE).select(*out.columns, F.col("t.color").alias("color"), F.round(F.col("t.c") / F.col("n"), 3).alias("color_share"))


def band_average_regressed(source: DataFrame, target: DataFrame, low: float = 280, high: float = 380, least: float = 0.78) -> DataFrame:
    def avg(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col("bbox.y0").between(low, high)).groupBy(*PAGE).agg(F.avg("size").alias(name))

    return avg(source, "source_size").join(avg(target, "target_size"), PAGE).where(F.col("target_size") < least * F.col("source_size"))


def page_bands(lines: DataFrame) -> DataFrame:
    band = F.when(F.col("bbox.y1") <= 0.22 * F.col("page_height"), "header").when(F.col("bbox.y0") >= 0.78 * F.col("page_height"), "footer").otherwise("body")
    return lines.withColumn("band", band)


def metadata_similarity(left: DataFrame, right: DataFrame, least: float = 0.45) -> DataFrame:
    """Header and footer lines of two sides, best partner on the same page and band by token likeness."""
    def of(df: DataFrame, side: str) -> DataFrame:
        return page_bands(df).where("band <> 'body'").select(*PAGE, "band", F.col("line_index").alias(f"{side}_line"), T.token_set(F.col("text")).alias(f"_{side}t"), T.canonical(F.col("text")).alias(f"_{side}c"))

    met = of(left, "l").join(of(right, "r"), [*PAGE, "band"])
    same = F.size(F.array_intersect("_lt", "_rt"))
    coverage = same / F.greatest(F.lit(1), F.size("_lt"))
    bonus = F.when((F.length("_lc") >= 16) & F.col("_rc").contains(F.col("_lc")), 0.35).otherwise(0.0)
    scored = met.withColumn("score", F.round(F.greatest(T.jaccard(F.col("_lt"), F.col("_rt")), 0.75 * coverage, bonus), 3)).where(F.col("score") >= least)
    return scored.groupBy(*PAGE, "band", "l_line").agg(F.max_by(F.struct("r_line", "score"), F.struct("score", -F.col("r_line"))).alias("m")).select(*PAGE, "band", "l_line", "m.r_line", "m.score")


def years_moved(source: DataFrame, target: DataFrame, dx: float = 80, dy: float = 40) -> DataFrame:
    """Cover years whose nearest equal on the other side lies too far off."""
    def of(df: DataFrame, p: str) -> DataFrame:
        y = df.where(F.trim("text").rlike(r"^(?:19|20)\d{2}$"))
        return y.select(*PAGE, F.trim("text").alias("year"), ((F.col("bbox.x0") + F.col("bbox.x1")) / 2).alias(f"{p}x"), ((F.col("bbox.y0") + F.col("bbox.y1")) / 2).alias(f"{p}y"))

    gap = F.abs(F.col("sx") - F.col("tx")) + F.abs(F.col("sy") - F.col("ty"))
    best = of(source, "s").join(of(target, "t"), [*PAGE, "year"]).groupBy(*PAGE, "year", "sx", "sy").agg(F.min_by(F.struct("tx", "ty"), gap).alias("m"))
    return best.where((F.abs(F.col("sx") - F.col("m.tx")) > dx) | (F.abs(F.col("sy") - F.col("m.ty")) > dy)).select(*PAGE, "year")


def merged_list_items(source: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, page, line_index, text``: the first target line with two or more item markers, where the source has two
    or more items on lines of their own."""
    items = source.where(F.col("text").rlike(r"^\s*[1-9][.)]\s+")).groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").alias("_n")).where("_n >= 2")
    marks = F.regexp_extract_all(T.text("text"), F.lit(r"(?:^|\s)([1-9][.)])\s+"), 1)
    hits = target.where(F.size(F.array_distinct(marks)) >= 2).join(items, F.col("doc_id") == F.col("_d"), "left_semi")
    return hits.groupBy("doc_id").agg(F.min_by(F.struct("page", "line_index", "text"), F.struct("page", "line_index")).alias("m")).select("doc_id", "m.*")


# Headings and phrases of the last pages, in the source's and the target's language.
BACK_MATTER = (
    "Acknowledgements", "Author contributions", "Competing interests", "Ethics approval", "Informed consent", "Additional information", "Supplementary information", "Correspondence and requests for materials",
    "Reprints and permission information", "Publisher's note", "Publisher’s note", "This research was supported", "The authors declare no competing interests", "did not require ethical approval", "informed consent was therefore not required",
)
BACK_MATTER_TRANSLATED = ("致谢", "作者贡献", "利益冲突", "伦理批准", "知情同意", "附加信息", "补充信息", "通讯及材料请求", "转载与授权", "出版方声明", "不存在利益冲突", "无需伦理", "无需取得知情同意")


def back_matter(lines: DataFrame, from_page: int = 10) -> DataFrame:
    """``doc_id, status, n_english, n_translated``: which marks of back matter the last pages show."""
    marks = lines.where(F.col("page") >= from_page).select("doc_id", T.text("text").alias("t"))
    own = [(F.lower("t").contains(m.lower()), f"e{i}") for i, m in enumerate(BACK_MATTER)] + [(F.col("t").contains(m), f"t{i}") for i, m in enumerate(BACK_MATTER_TRANSLATED)]
    seen = marks.groupBy("doc_id").agg(*[F.max(c.cast("int")).alias(n) for c, n in own])
    total = lambda p, n: sum((F.col(f"{p}{i}") for i in range(1, n)), F.col(f"{p}0"))
    out = seen.select("doc_id", total("e", len(BACK_MATTER)).cast("long").alias("n_english"), total("t", len(BACK_MATTER_TRANSLATED)).cast("long").alias("n_translated"))
    e, t = F.col("n_english") > 0, F.col("n_translated")
    return out.withColumn("status", F.when(e & (t > 0), "mixed").when(e, "english_visible").when(t >= 3, "translated_visible").otherwise("unknown"))


def pixel_ratios(pixels: DataFrame) -> DataFrame:
    """``doc_id, page, n, nonwhite_ratio, colored_ratio, n_colors`` from decoded pixels (r, g, b)."""
    low, high = F.least("r", "g", "b"), F.greatest("r", "g", "b")
    out = pixels.groupBy(*PAGE).agg(F.count("*").alias("n"), F.count_if(low < 245).alias("_w"), F.count_if((high - low >= 18) & (low < 245)).alias("_c"), F.count_distinct("r", "g", "b").alias("n_colors"))
    return out.select(*PAGE, "n", F.round(F.col("_w") / F.col("n"), 4).alias("nonwhite_ratio"), F.round(F.col("_c") / F.col("n"), 4).alias("colored_ratio"), "n_colors")


def layout_map(paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of a layout from tracked paragraphs (doc_id, nth, tracking_group, page, debug_id, layout_id, layout_label,
    input, output, fallback), with ``engine_block_id`` and ``fallback_status``; and shares of both by document."""
    where = F.concat(F.coalesce("tracking_group", F.lit("tracking")), F.lit(":p"), F.coalesce(F.col("page").cast("string"), F.lit("None")))
    named = F.when(T.text("debug_id") != "", F.concat(F.lit(":debug:"), "debug_id")).when(T.text("layout_id") != "", F.concat(F.lit(":layout:"), "layout_id")).otherwise(F.format_string(":order:%04d", F.col("nth")))
    s, o = T.strip(F.col("input")), T.strip(F.col("output"))
    same = (s != "") & (o != "") & (T.normalize(s) == T.normalize(o))
    status = F.when(F.coalesce("fallback", F.lit(False)), "fallback_to_translate").when(same, "same_as_input").when(T.has_cjk(o) & o.rlike("[A-Za-z]{3,}"), "mixed_or_partial_output").otherwise("translated_or_passthrough")
    blocks = paragraphs.withColumn("engine_block_id", F.concat(where, named)).withColumn("fallback_status", status)
    shares = blocks.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.round(F.avg((T.text("layout_label") != "").cast("int")), 3).alias("label_coverage"), F.round(F.avg((F.col("fallback_status") != "translated_or_passthrough").cast("int")), 3).alias("fallback_ratio"))
    return blocks, shares
