"""Queries of the operators on lines, blocks and terms, over documents with page markers and running lines added."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import blocks, terms
from .registry import picked, picked_sql, query, quoted, table
from .text_queries import CJK, collapsed, has, n_of, sub

_HEAD = "Running header line of the series"
_TOP, _TAIL = f"<!-- page:1 -->\n{_HEAD}\n", f"\n<!-- page:2 -->\n{_HEAD}\nPage 2\nDOI: 10.1/x\nThis line is the body of page two\nReceived 4 May\nReferences\nSmith 2020\n3/4/21"
_PAGED = f"(SELECT doc_id, {quoted(_TOP)} || text || {quoted(_TAIL)} AS text FROM documents)"
_LINES = f"""(SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {_PAGED}))"""
_MARKED = rf"""(SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS page, mark IS NOT NULL AS is_marker FROM (SELECT *, {collapsed("line")} AS body, try_cast(nullif(regexp_extract(line, '<!--\s*page:(\d+)\s*-->', 1), '') AS INT) AS mark FROM {_LINES}))"""


def paged(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(_TOP), "text", F.lit(_TAIL)).alias("text"))


def noise_sql(x: str, repeated: str = "false") -> str:
    def word(p: str) -> str:
        return has(x, rf"(?i)(?:^|[^A-Za-z0-9_])(?:{p})(?:[^A-Za-z0-9_]|$)")

    return rf"""CASE WHEN {x} = '' THEN '' WHEN {has(x, r'(?i)^(?:page\s*)?\d+$')} THEN 'page_number' WHEN {has(x, '(?i)^ARTICLE$')} THEN 'article_marker' WHEN {has(x, '(?i)^OPEN$')} THEN 'article_open_marker'
 WHEN {x} = '1234567890():,;' THEN 'decorative_glyph_probe' WHEN {word('copyright|all rights reserved|published by|license')} THEN 'copyright' WHEN {has(x, r'(?i)^(?:doi|https?://doi\.org|www\.nature\.com|nature\.com)(?:[^A-Za-z0-9_]|$)')} THEN 'doi_footer'
 WHEN {has(x, r'(?i)(?:^|[^A-Za-z0-9_])(?:humanities and social sciences communications|nature|springer|elsevier|acm|ieee)(?:[^A-Za-z0-9_].*)?\|\s*(?:\(?\d{4}\)?|\d+)')} THEN 'journal_footer' WHEN {has(x, r'(?i)^arxiv\s*:\s*\d{4}\.\d+')} THEN 'arxiv_footer'
 WHEN {repeated} THEN 'repeated_header_footer' WHEN length({x}) <= 140 AND {word('doi|arxiv|issn|isbn|copyright|received|accepted|published|corresponding author|e-?mail')} THEN 'metadata_line' ELSE '' END"""


_REPEATED = f"""(SELECT doc_id, body, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first, body) AS rank FROM (SELECT doc_id, body, count(*) AS n, min(pos) AS first FROM (SELECT doc_id, page, body, min(pos) AS pos FROM {_MARKED} WHERE NOT is_marker AND length(body) BETWEEN 16 AND 140 AND NOT regexp_full_match(body, '\\d+') GROUP BY ALL) GROUP BY doc_id, body HAVING count(*) >= 2) QUALIFY rank <= 10)"""
_JUDGED = f"""(SELECT m.*, CASE WHEN is_marker THEN '' ELSE {noise_sql("m.body", "r.body IS NOT NULL")} END AS reason FROM {_MARKED} m LEFT JOIN {_REPEATED} r ON m.doc_id = r.doc_id AND m.body = r.body)"""


@query(f"SELECT doc_id, body AS line, n, rank FROM {_REPEATED}")
def repeated_page_lines(spark, sf_dir):
    rows = blocks.with_pages(blocks.lines(paged(spark, sf_dir))).where("not is_marker")
    return blocks.repeated_lines(rows).select("doc_id", "line", "n", F.col("rank").cast("long"))


@query(f"""SELECT doc_id, printf('metadata-%04d', row_number() OVER (PARTITION BY doc_id ORDER BY pos)) AS metadata_id, page, reason AS noise_reason, body AS text, length(body) AS char_count FROM {_JUDGED} WHERE reason <> ''""")
def noise_rows(spark, sf_dir):
    return blocks.split_noise(paged(spark, sf_dir))[1].withColumn("char_count", F.col("char_count").cast("long"))


@query(f"""SELECT doc_id, sha256(regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS kept FROM {_JUDGED} WHERE reason = '' GROUP BY doc_id""")
def kept_text(spark, sf_dir):
    return blocks.split_noise(paged(spark, sf_dir))[0].select("doc_id", F.sha2("text", 256).alias("kept"))


_HEADING = r"(?i)^(?:abstract|introduction|related work|methodology|methods|experiments|results|discussion|conclusion|references)(?:[^\p{L}\p{N}_]|$)"
_BLOCKS = rf"""(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS nth, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY island), '') AS section FROM (
 SELECT doc_id, island, any_value(page) AS page, regexp_replace(string_agg(regexp_replace(line, '\s+$', ''), chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS text, CASE WHEN bool_or(head) THEN trim(regexp_replace(trim(string_agg(line, chr(10) ORDER BY pos)), '^#{{1,6}}\s*', '')) END AS heading FROM (
 SELECT *, sum(start::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (
 SELECT *, NOT blank AND NOT is_marker AND (head OR coalesce(lag(blank OR head OR is_marker) OVER (PARTITION BY doc_id ORDER BY pos), true)) AS start FROM (
 SELECT *, body = '' AS blank, NOT is_marker AND ({has("trim(line)", _HEADING)} OR {has("trim(line)", r"^#{1,6}\s+\S+")}) AS head FROM {_MARKED}))) WHERE NOT blank AND NOT is_marker GROUP BY doc_id, island))"""


@query(f"""SELECT doc_id, section, string_agg(printf('block-%04d', nth), ',' ORDER BY nth) AS block_ids, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages, sum(length(text))::BIGINT AS char_count, arg_min(CASE WHEN length({collapsed("text")}) <= 180 THEN {collapsed("text")} ELSE substr({collapsed("text")}, 1, 179) || '…' END, nth) AS excerpt FROM {_BLOCKS} GROUP BY doc_id, section""")
def paged_sections(spark, sf_dir):
    s = blocks.sections(blocks.build_blocks(paged(spark, sf_dir)))
    return s.select("doc_id", "section", F.array_join("block_ids", ",").alias("block_ids"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "char_count", "excerpt")


@query(f"""WITH t AS (SELECT doc_id, page, right({collapsed("string_agg(text, chr(10) ORDER BY nth)")}, 80) AS tail FROM {_BLOCKS} GROUP BY doc_id, page), a AS (SELECT *, regexp_extract_all(tail, '20\\d{{2}}|[A-Za-z]{{12,}}') AS found FROM t) SELECT doc_id, page, tail, array_to_string(found[greatest(1, len(found) - 2):], '|') AS anchors FROM a""")
def page_ends(spark, sf_dir):
    return blocks.page_tails(blocks.build_blocks(paged(spark, sf_dir))).select("doc_id", "page", "tail", F.array_join("anchors", "|").alias("anchors"))


@query(f"""WITH l AS (SELECT doc_id, pos, line FROM {_LINES}), f AS (SELECT doc_id, min(pos) AS first FROM l WHERE lower(trim(line)) IN ('references', 'bibliography') GROUP BY doc_id)
SELECT doc_id, pos, line FROM l JOIN f USING (doc_id) WHERE pos > first AND lower(trim(line)) NOT IN ('open', '') AND NOT {has("line", r"^\s*\d{1,2}[/.]\d{1,2}[/.]\d{2,4}")}""")
def reference_lines(spark, sf_dir):
    return blocks.reference_tail(blocks.lines(paged(spark, sf_dir)), ignored=("open",)).select("doc_id", F.col("pos").cast("long"), "line")


@query(f"SELECT doc_id, pos // 50 AS page, pos AS line_index, substr(line, 1, 40) AS head FROM {_LINES}")
def line_order(spark, sf_dir):
    rows = blocks.lines(paged(spark, sf_dir)).select("doc_id", F.expr("pos div 50").alias("page"), F.col("pos").cast("long").alias("line_index"), F.col("line").alias("text"))
    return blocks.line_order_signature(rows)


_NEAR = "list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))"


@query(f"""WITH a AS (SELECT doc_id AS page, {_NEAR} AS w, length(text) AS n FROM documents), b AS (SELECT doc_id + 1 AS other, {_NEAR} AS w, length(text) AS n FROM documents),
s AS (SELECT a.page, other, least(a.n, b.n) AS chars, CASE WHEN len(list_distinct(list_concat(a.w, b.w))) > 0 THEN round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 3) ELSE 0 END AS score FROM a JOIN b ON other BETWEEN a.page - 1 AND a.page + 1),
g AS (SELECT page, max(score) FILTER (WHERE other = page) AS same, max(score) AS best, arg_max(other, (score * 1000)::BIGINT * 1000000000 - other) AS best_page, max(chars) FILTER (WHERE other = page) AS chars FROM s GROUP BY page)
SELECT page, same, best, best_page, CASE WHEN chars >= 500 AND same < 0.28 AND NOT (best_page <> page AND best >= 0.55) THEN 'warn' ELSE 'ok' END AS status FROM g""")
def neighbouring_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return blocks.adjacent_best_match(d.select(F.col("doc_id").alias("page"), "text"), d.select((F.col("doc_id") + 1).alias("page"), "text"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, count(*) AS times, max((l_returnflag = 'R')::INT) AS bad FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL), m AS (SELECT o.o_custkey, s.times, coalesce(s.bad, 0) AS bad FROM orders o LEFT JOIN s USING (o_custkey, o_orderkey)),
g AS (SELECT o_custkey, count(*) AS expected, count(*) FILTER (WHERE times IS NULL) AS missing, count(*) FILTER (WHERE times > 1) AS duplicated, count(*) FILTER (WHERE bad > 0) AS errored FROM m GROUP BY o_custkey)
SELECT *, round((expected - missing - errored) / expected, 3) AS coverage, CASE WHEN missing + errored > 0 THEN 'warn' ELSE 'ok' END AS status FROM g""")
def coverage_windows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    seen = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderkey", F.when(F.col("l_returnflag") == "R", "error").otherwise("ok").alias("status"))
    return blocks.coverage_by_page(o, seen, ["o_custkey"], "o_orderkey")


@query("""SELECT conv_id AS doc_id, sha256(string_agg('<!-- ' || role || turn::VARCHAR || ' -->' || chr(10) || CASE WHEN turn % 3 <> 0 THEN text ELSE '[untranslated]' END, chr(10) || chr(10) ORDER BY turn)) AS merged FROM conversations GROUP BY conv_id""")
def merged_blocks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.concat("role", F.col("turn").cast("string")).alias("block_id"), F.when(F.col("turn") % 3 != 0, "ok").otherwise("failed").alias("status"), F.col("text").alias("translation"))
    return blocks.merge_blocks(c).select("doc_id", F.sha2("text", 256).alias("merged"))


# --- terms ------------------------------------------------------------------------------------------

_FOUND = ("the", "License", "Running", "header line", "DOI:", "re-", "10", "und", "")


def _term_sql(body: str, term: str) -> str:
    return f"({term} <> '' AND CASE WHEN regexp_matches({term}, '^[A-Za-z0-9+-]+$') THEN regexp_matches(coalesce({body}, ''), '(^|[^A-Za-z0-9])' || regexp_escape({term}) || '([^A-Za-z0-9]|$)') ELSE contains(coalesce({body}, ''), {term}) END)"


_HITS = f"(SELECT b.doc_id, b.nth, t.term FROM {_BLOCKS} b JOIN (SELECT unnest([{', '.join(map(quoted, _FOUND))}]) AS term) t ON {_term_sql('b.text', 't.term')})"


def _found(spark):
    return spark.createDataFrame([(t,) for t in _FOUND], "term string")


@query(f"SELECT doc_id, term, printf('block-%04d', min(nth)) AS first_seen_block FROM {_HITS} GROUP BY doc_id, term")
def first_blocks_of_terms(spark, sf_dir):
    return terms.first_seen(blocks.build_blocks(paged(spark, sf_dir)), _found(spark))


@query(f"SELECT doc_id, printf('block-%04d', nth) AS block_id, array_to_string(list_sort(list_distinct(list(term))), '|') AS terms FROM {_HITS} GROUP BY doc_id, nth")
def blocks_of_terms(spark, sf_dir):
    return terms.affected_blocks(blocks.build_blocks(paged(spark, sf_dir)), _found(spark)).select("doc_id", "block_id", F.array_join("terms", "|").alias("terms"))


_SOURCE = ("An LLM with RAG", "Literature Review of AI", "The LLMs 50% and 7 %", "memory (AI)", "# One\n# Two\n## Three\ntext", "see https://a.org/x and [3]", None, "plain")
_TARGET = ("大型语言模型与检索增强生成", "文学评论", "LLMs 占 50％", "法学硕士 AI", "# 一\n文", "见 https://a.org/x", "", "记忆 memory", "LLM（大型语言模型） 7%", None)
_POLICIES = (("LLM", "LLM（大型语言模型）", "keep+explain", ("法学硕士",)), ("RAG", "检索增强生成", "translate", ()), ("AI", "", "keep", ()), ("memory", "记忆", "translate", ("回忆",)), ("Literature Review", "文献综述", "translate", ("文学评论",)), ("plain", "", "translate", ()))
_PAIRS = f"(SELECT o_orderkey AS block_id, {picked_sql('o_orderkey', _SOURCE)} AS source, {picked_sql('o_orderkey // 3', _TARGET)} AS translation FROM orders)"


def _pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("third", F.expr("o_orderkey div 3"))
    return o.select(F.col("o_orderkey").alias("block_id"), picked("o_orderkey", _SOURCE).alias("source"), picked("third", _TARGET).alias("translation"))


@query(f"""WITH p(term, expected, action, forbidden) AS (VALUES {", ".join(f"({quoted(t)}, {quoted(e)}, {quoted(a)}, [{', '.join(map(quoted, f))}]::VARCHAR[])" for t, e, a, f in _POLICIES)}),
m AS (SELECT block_id, term, coalesce(translation, '') AS t, expected, len(list_filter(forbidden, lambda w: contains(coalesce(translation, ''), w))) > 0 AS bad, starts_with(action, 'keep') AND {_term_sql("translation", "term")} AS kept,
 len(list_filter([expected, trim(regexp_extract(expected, '[（(]([^）)]+)[）)]', 1)), trim(regexp_extract(expected, '^([^（(]*)[（(]', 1))], lambda w: w <> '' AND contains(coalesce(translation, ''), w))) > 0 AS good FROM {_PAIRS} JOIN p ON {_term_sql("source", "term")}),
j AS (SELECT block_id, term, CASE WHEN bad THEN 'high' WHEN expected = '' THEN CASE WHEN kept THEN NULL ELSE 'low' END WHEN NOT good AND NOT kept THEN 'medium' END AS severity FROM m)
SELECT block_id, term, severity, CASE severity WHEN 'high' THEN 'forbidden wording' WHEN 'low' THEN 'no expected wording' ELSE 'expected wording missing' END AS title FROM j WHERE severity IS NOT NULL""")
def policy_issues(spark, sf_dir):
    return terms.check_policies(_pairs(spark, sf_dir), spark.createDataFrame([(t, e, a, list(f)) for t, e, a, f in _POLICIES], "term string, expected string, action string, forbidden array<string>"))


_PERCENTS = "list_distinct(list_transform(regexp_extract_all(replace(coalesce({}, ''), '％', '%'), '\\d+(?:\\.\\d+)?\\s*%'), lambda p: regexp_replace(p, '\\s+', '', 'g')))"


@query(f"""WITH a AS (SELECT block_id, {_PERCENTS.format("source")} AS s, {_PERCENTS.format("translation")} AS t FROM {_PAIRS}), b AS (SELECT block_id, list_sort(list_filter(s, lambda x: NOT list_contains(t, x))) AS missing, list_sort(list_filter(t, lambda x: NOT list_contains(s, x))) AS added FROM a)
SELECT block_id, array_to_string(missing, '|') AS missing, array_to_string(added, '|') AS added FROM b WHERE len(missing) > 0 OR len(added) > 0""")
def quantity_issues(spark, sf_dir):
    out = terms.check_quantities(_pairs(spark, sf_dir))
    return out.select("block_id", *[F.array_join(F.array_sort(c), "|").alias(c) for c in ("missing", "added")])


@query(f"""WITH a AS (SELECT s.block_id AS doc_id, {n_of("coalesce(source, '')", r"(?m)^#{1,6}\s+\S")} AS n, {n_of("coalesce(translation, '')", r"(?m)^#{1,6}\s+\S")} AS m FROM {_PAIRS} s) SELECT doc_id, n, m FROM a WHERE n >= 3 AND m < greatest(1, floor(n / 2))""")
def section_count_issues(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    out = terms.check_sections(p.select(F.col("block_id").alias("doc_id"), F.col("source").alias("text")), p.select(F.col("block_id").alias("doc_id"), F.col("translation").alias("text")))
    return out.select("doc_id", F.col("n").cast("long"), F.col("m").cast("long"))


_KEPT = (("url", "https://a.org/x"), ("citation", "[3]"), ("variable", "LLM"), ("doi", "10.1/x"), ("inline_code", "`a`"))


@query(f"""WITH s AS (SELECT block_id, {picked_sql("block_id", [k for k, _ in _KEPT])} AS kind, {picked_sql("block_id", [v for _, v in _KEPT])} AS value, translation FROM {_PAIRS})
SELECT block_id, kind, value, CASE WHEN kind IN ('url', 'doi', 'citation') THEN 'high' ELSE 'medium' END AS severity FROM s WHERE kind <> 'variable' AND NOT contains(coalesce(translation, ''), value)""")
def protected_issues(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    spans = p.select("block_id", picked("block_id", [k for k, _ in _KEPT]).alias("kind"), picked("block_id", [v for _, v in _KEPT]).alias("value"))
    return terms.check_protected(p.select("block_id", "translation"), spans)


@query(f"""WITH p AS (SELECT *, {has("coalesce(source, '')", r"\bLLMs?\b")} AND contains(coalesce(translation, ''), '法学硕士') AS a, contains(coalesce(source, ''), 'Literature Review') AND contains(coalesce(translation, ''), '文学评论') AS b FROM {_PAIRS})
SELECT block_id, 'high' AS severity, 'LLM' AS term FROM p WHERE a UNION ALL SELECT block_id, 'medium', 'Literature Review' FROM p WHERE b""")
def acronym_issues(spark, sf_dir):
    return terms.check_acronyms(_pairs(spark, sf_dir))


@query("""WITH base AS (SELECT p_partkey, p_brand, p_type FROM part WHERE p_partkey % 3 <> 0), e AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN 'size ' || p_size::VARCHAR ELSE '' END AS p_brand, 'x' AS p_type FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(b.p_partkey, e.p_partkey) AS p_partkey, coalesce(nullif(e.p_brand, ''), b.p_brand) AS p_brand, coalesce(e.p_type, b.p_type) AS p_type FROM base b FULL OUTER JOIN e ON b.p_partkey = e.p_partkey""")
def edits_over_base(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    edits = p.where("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_size") > 25, F.concat(F.lit("size "), F.col("p_size").cast("string"))).otherwise("").alias("p_brand"), F.lit("x").alias("p_type"))
    return terms.upsert(p.where("p_partkey % 3 <> 0").select("p_partkey", "p_brand", "p_type"), edits, "p_partkey", ["p_brand", "p_type"])
