"""Queries of the operators on positioned text: every order is a span whose box, size and text follow from its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import spatial
from .registry import picked, picked_sql, query, table
from .text_queries import normal

_TEXTS = ("12", "Introduction to it", "7", "Figure 3: flow", "图 3 流程", "Table 4", "2019", "Report 2020", "2019", "Header words here and there", "header words here", "45", "fig. 3", None)
_WIDTH, _HEIGHT = 520.0, 710.0
_SPANS = f"""(SELECT *, x0 + w AS x1, y0 + h AS y1, w * h AS area FROM (SELECT o_custkey // 10 AS doc_id, (o_orderkey % 4)::INT AS page, o_orderkey AS span_id, ((o_orderkey * 37) % 503)::DOUBLE AS x0, ((o_orderkey * 9176) % 70001)::DOUBLE / 100::DOUBLE AS y0,
 (20 + (o_orderkey * 13) % 120)::DOUBLE AS w, (10 + o_orderkey % 8)::DOUBLE AS h, (6 + (o_orderkey * 7) % 20)::DOUBLE AS size, {picked_sql("o_orderkey", _TEXTS)} AS text, (o_orderkey % 5)::INT AS color FROM orders))"""
_SOURCE, _TARGET = f"(SELECT * FROM {_SPANS} WHERE span_id % 2 = 0)", f"(SELECT * FROM {_SPANS} WHERE span_id % 2 = 1)"


def spans(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.expr("o_custkey div 10").alias("doc_id"), (k % 4).cast("int").alias("page"), k.alias("span_id"), ((k * 37) % 503).cast("double").alias("x0"), (((k * 9176) % 70001).cast("double") / 100).alias("y0"), (20 + (k * 13) % 120).cast("double").alias("w"), (10 + k % 8).cast("double").alias("h"), (6 + (k * 7) % 20).cast("double").alias("size"), picked("o_orderkey", _TEXTS).alias("text"), (k % 5).cast("int").alias("color"))
    box = F.struct("x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))
    return o.select("doc_id", "page", "span_id", F.col("span_id").alias("line_index"), box.alias("bbox"), "size", "text", "color", F.lit(_WIDTH).alias("page_width"), F.lit(_HEIGHT).alias("page_height"))


def sides(spark, sf_dir):
    s = spans(spark, sf_dir)
    return s.where("span_id % 2 = 0"), s.where("span_id % 2 = 1")


@query(f"""SELECT a.doc_id, a.page, a.span_id AS a, b.span_id AS b FROM {_SPANS} a JOIN {_SPANS} b ON a.doc_id = b.doc_id AND a.page = b.page AND a.span_id < b.span_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
WHERE (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.1""")
def overlapping_spans(spark, sf_dir):
    return spatial.overlaps(spans(spark, sf_dir), 0.1).select("doc_id", "page", "a", "b")


@query(f"""SELECT doc_id, page, s, t, ss >= 8.5 AND ts < 0.86::DOUBLE * ss AND NOT (ss >= 24 AND ts >= 0.75::DOUBLE * ss) AS regressed FROM (
SELECT a.doc_id, a.page, a.span_id AS s, b.span_id AS t, a.size AS ss, b.size AS ts, 4 * abs(a.y0 - b.y0) + abs(a.x0 - b.x0) + 2 * abs(a.size - b.size) + 8 * greatest(0::DOUBLE, 0.86::DOUBLE * a.size - b.size) AS cost FROM {_SOURCE} a JOIN {_TARGET} b ON a.doc_id = b.doc_id AND a.page + 1 = b.page) QUALIFY row_number() OVER (PARTITION BY s ORDER BY cost, t) = 1""")
def nearest_spans(spark, sf_dir):
    a, b = sides(spark, sf_dir)  # even keys lie on even pages, so the target's are moved up
    return spatial.nearest(a, b.withColumn("page", F.col("page") - 1))


@query(f"""SELECT l.doc_id, l.page, l.span_id FROM {_SPANS} l WHERE regexp_full_match(trim(text), '\\d{{1,3}}') AND x0 >= 0.55::DOUBLE * {_WIDTH}::DOUBLE AND NOT EXISTS (SELECT 1 FROM {_SPANS} t WHERE t.doc_id = l.doc_id AND t.page = l.page AND t.text IS NOT NULL AND NOT regexp_full_match(trim(t.text), '\\d+') AND abs(l.y0 - t.y0) <= 8.5)""")
def lonely_page_numbers(spark, sf_dir):
    return spatial.unpaired_numbers(spans(spark, sf_dir)).select("doc_id", "page", "span_id")


@query(f"""SELECT s.doc_id, s.page, s.span_id FROM {_SPANS} s WHERE s.size < 12 AND EXISTS (SELECT 1 FROM {_SPANS} b WHERE b.doc_id = s.doc_id AND b.page = s.page AND b.text = s.text AND b.size >= 12 AND abs(s.x0 - b.x0) <= 300 AND abs(s.y0 - b.y0) <= 200)""")
def small_twins(spark, sf_dir):
    return spatial.with_good_twin(spans(spark, sf_dir), 12, 300, 200).select("doc_id", "page", "span_id")


_NUMBER = "regexp_extract(coalesce({}.text, ''), '(?i)(?:figure|fig\\.|table|图|表)\\s*(\\d+)', 1)"


@query(f"""SELECT s.doc_id, s.page, s.span_id FROM {_SOURCE} s WHERE {_NUMBER.format("s")} <> '' AND NOT EXISTS (SELECT 1 FROM {_TARGET} t WHERE t.doc_id = s.doc_id AND t.page = s.page + 1 AND {_NUMBER.format("t")} = {_NUMBER.format("s")} AND abs(s.y0 - t.y0) <= 200)""")
def lost_captions(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return spatial.missing_captions(a, b.withColumn("page", F.col("page") - 1), 200).select("doc_id", "page", "span_id")


_ORDERED = f"(SELECT *, (x0 >= 0.65::DOUBLE * {_WIDTH}::DOUBLE)::INT AS side FROM {_SPANS})"


@query(f"""SELECT span_id, side AS "column", row_number() OVER (PARTITION BY doc_id, page, side ORDER BY round(y0, 1), x0) AS nth FROM {_ORDERED}""")
def reading_orders(spark, sf_dir):
    return spatial.reading_order(spans(spark, sf_dir)).select("span_id", "column", F.col("nth").cast("long"))


@query(f"""WITH n AS (SELECT doc_id, page, side, trim(text)::INT AS number, y0, coalesce(lag(y0) OVER (PARTITION BY doc_id, page, side ORDER BY y0), '-infinity'::DOUBLE) AS above FROM {_ORDERED} WHERE regexp_full_match(trim(text), '\\d{{1,3}}')),
p AS (SELECT * FROM {_ORDERED} WHERE text IS NOT NULL AND NOT regexp_full_match(trim(text), '\\d+'))
SELECT n.doc_id, n.page, n.side AS "column", number, string_agg(trim(p.text), ' ' ORDER BY p.y0, p.x0, p.text) AS title FROM n JOIN p ON p.doc_id = n.doc_id AND p.page = n.page AND p.side = n.side AND p.y0 > n.above + 1 AND p.y0 <= n.y0 + 1 GROUP BY n.doc_id, n.page, n.side, number, n.y0""")
def contents_rows(spark, sf_dir):
    return spatial.toc_rows(spatial.reading_order(spans(spark, sf_dir)))


@query(f"""WITH c AS (SELECT doc_id, page, color, count(*) AS c FROM {_SPANS} GROUP BY ALL), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY c DESC, color) = 1)
SELECT s.doc_id, s.page, count(*) AS n, min(size) AS smallest, max(size) AS largest, round(avg(size), 2) AS average, count(*) FILTER (WHERE size < 6) AS under_6, count(*) FILTER (WHERE size >= 6 AND size < 8) AS to_8, count(*) FILTER (WHERE size >= 8 AND size < 14) AS to_14, count(*) FILTER (WHERE size >= 14) AS over_14, any_value(t.color) AS color, round(any_value(t.c) / count(*), 3) AS color_share
FROM {_SPANS} s JOIN t ON s.doc_id = t.doc_id AND s.page = t.page GROUP BY s.doc_id, s.page""")
def page_typography(spark, sf_dir):
    return spatial.typography(spans(spark, sf_dir))


@query(f"""WITH s AS (SELECT doc_id, page, avg(size) AS v FROM {_SOURCE} WHERE y0 BETWEEN 100 AND 500 GROUP BY ALL), t AS (SELECT doc_id, page - 1 AS page, avg(size) AS v FROM {_TARGET} WHERE y0 BETWEEN 100 AND 500 GROUP BY ALL)
SELECT doc_id, page, round(s.v, 4) AS source_size, round(t.v, 4) AS target_size FROM s JOIN t USING (doc_id, page) WHERE t.v < 0.9::DOUBLE * s.v""")
def shrunken_bands(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    out = spatial.band_average_regressed(a, b.withColumn("page", F.col("page") - 1), 100, 500, 0.9)
    return out.select("doc_id", "page", F.round("source_size", 4).alias("source_size"), F.round("target_size", 4).alias("target_size"))


_YEARS = "SELECT doc_id, {} AS page, trim(text) AS year, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, span_id FROM {} WHERE regexp_full_match(trim(text), '(?:19|20)\\d{{2}}')"


@query(f"""WITH s AS ({_YEARS.format("page", _SOURCE)}), t AS ({_YEARS.format("page - 1", _TARGET)}), m AS (SELECT s.doc_id, s.page, s.year, s.x, s.y, t.x AS tx, t.y AS ty FROM s JOIN t USING (doc_id, page, year) QUALIFY row_number() OVER (PARTITION BY s.doc_id, s.page, s.year, s.x, s.y ORDER BY abs(s.x - t.x) + abs(s.y - t.y)) = 1)
SELECT doc_id, page, year FROM m WHERE abs(x - tx) > 80 OR abs(y - ty) > 40""")
def moved_years(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return spatial.years_moved(a, b.withColumn("page", F.col("page") - 1))


_CANON = f"trim(regexp_replace({normal('text')}, '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g'))"
_BANDED = f"""(SELECT *, CASE WHEN y1 <= 0.22::DOUBLE * {_HEIGHT}::DOUBLE THEN 'header' WHEN y0 >= 0.78::DOUBLE * {_HEIGHT}::DOUBLE THEN 'footer' ELSE 'body' END AS band, {_CANON} AS c,
 list_distinct(list_filter(regexp_extract_all({_CANON}, '[a-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]'), lambda x: (length(x) > 1 OR regexp_matches(x, '[\\x{{4e00}}-\\x{{9fff}}]')) AND x NOT IN ('the','and','for','with','from','this','that','into','are','was','were'))) AS tokens FROM {_SPANS})"""


@query(f"""WITH l AS (SELECT * FROM {_BANDED} WHERE span_id % 2 = 0 AND band <> 'body'), r AS (SELECT * REPLACE (page - 1 AS page) FROM {_BANDED} WHERE span_id % 2 = 1 AND band <> 'body'),
m AS (SELECT l.doc_id, l.page, l.band, l.span_id AS l_line, r.span_id AS r_line, len(list_intersect(l.tokens, r.tokens)) AS i, len(list_distinct(list_concat(l.tokens, r.tokens))) AS u, greatest(1, len(l.tokens)) AS n, length(l.c) >= 16 AND contains(r.c, l.c) AS held FROM l JOIN r USING (doc_id, page, band)),
s AS (SELECT *, round(greatest(CASE WHEN u > 0 THEN i / u ELSE 0 END, 0.75::DOUBLE * (i / n), CASE WHEN held THEN 0.35 ELSE 0 END), 3) AS score FROM m)
SELECT doc_id, page, band, l_line, r_line, score FROM s WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY doc_id, page, band, l_line ORDER BY score DESC, r_line) = 1""")
def running_line_matches(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return spatial.metadata_similarity(a, b.withColumn("page", F.col("page") - 1))
