"""Queries of rules, terms, residue and protected spans, on made texts for every row of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import rulebook, spans, spatial, terms
from .registry import cases, cases_sql, picked, picked_sql, query, quoted, table
from .text_queries import CJK, collapsed, has, n_of, normal

_PAGES = (
    "HUMANITIES AND SOCIAL SCIENCES 通讯\nTable 1 shows\nIntroduction",
    "Figure 3.1 by sector 图\nNumber of notable AI models in Figure 2\n<style id=1>x</style>",
    "contact me@polyu.edu. hk\nT\nintroduction\nbody",
    "表 3 a __ b ___ c\nNumber of texts\nLLM-x: 你好",
    "References\nSmith, J. (2019) 你好你好你好你好你好 2020 2021\nJones 2022 " + "word " * 80,
    "doi.org/10.1 你好\nAI Index 人工智能指数 Economy",
    "polyu.edu.hk Hong Kong 你好 email a@polyu.edu.hk",
    "This chapter focuses on the many ways in which models are put to use across the economy 你好",
    "plain page\nwith nothing",
    None,
    "Overview\nMembers\nnotes",
)


def _page_sql(body: str) -> str:
    return f"(SELECT doc_id, 1 AS page, coalesce(s, '') AS text FROM {cases_sql('documents', 'doc_id', _PAGES)}) {body}"


def _pages(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", _PAGES).select("doc_id", F.lit(1).alias("page"), F.col("s").alias("text"))


_LINES = f"(SELECT doc_id, page, text, line FROM (SELECT doc_id, page, text, {collapsed('l')} AS line FROM (SELECT *, unnest(string_split(text, chr(10))) AS l FROM {_page_sql('')})) WHERE line <> '')"
_REFS = f"""({has("text", r"(?im)^\s*(?:references|参考文献)\s*[:：]?\s*$(?s:.*)\S")} OR (len(list_filter(regexp_extract_all(text, '\\d+'), lambda x: regexp_full_match(x, '(?:19|20)\\d{{2}}'))) >= 5 AND {n_of("text", "(?i)https?://|doi")} >= 1 AND ({n_of("text", r"[A-Z][a-z]+,\s+[A-Z]\.")} >= 3 OR {n_of("text", "(?i)journal|proceedings|conference|transactions|press")} >= 3)))"""
_KEPT = f"""(({has("line", r"[A-Za-z0-9_.%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")} AND NOT {has("line", r"(?i)@\s*$|@\s+|\.ed\s+u\b|\.edu\.\s+hk\b")} AND ({has("line", "香港理工大学|Hong Kong Polytechnic University|邮箱")} OR contains(lower(line), 'email'))) OR ({has("line", r"(?i)^(?:HUMANITIES\s+AND\s+SOCIAL\s+SCIENCES\s+COMMUNICATIONS\b|https://doi\.org/10\.1057/s41599)")} AND NOT {has("line", CJK)}))"""


def _line_rule(rule, least, most, pattern, also, cjk, outside) -> str:
    tests = [f"length(line) >= {least}", has("line", pattern.replace("一-鿿", r"\x{4e00}-\x{9fff}"))]
    tests += [f"length(line) <= {most}"] if most else []
    tests += [has("line", also.replace("一-鿿", r"\x{4e00}-\x{9fff}"))] if also else []
    tests += [has("line", CJK)] if cjk else []
    tests += [f"NOT ({_REFS} OR {_KEPT})"] if outside else []
    return f"SELECT doc_id, page, {quoted(rule)} AS rule, count(*) AS n FROM {_LINES} WHERE {' AND '.join(tests)} GROUP BY doc_id, page"


@query(" UNION ALL ".join(_line_rule(*r) for r in rulebook.LINE_RULES))
def semantic_lines(spark, sf_dir):
    return rulebook.line_rules(_pages(spark, sf_dir), rulebook.line_rule_rows(spark))


@query(f"SELECT doc_id, page, count(*) AS n FROM {_LINES} WHERE lower(line) IN ({', '.join(map(quoted, rulebook.HEADINGS_LEFT))}) GROUP BY doc_id, page")
def source_headings_left(spark, sf_dir):
    return rulebook.headings_left(_pages(spark, sf_dir))


@query(f"""WITH t AS (SELECT doc_id, page, text, regexp_extract(text, '(?im)^\\s*(?:references|参考文献)\\s*[:：]?\\s*$((?s:.*))', 1) AS t FROM {_page_sql("")}), y AS (SELECT *, {n_of("t", r"(?:19|20)\d{2}")} AS y, list_max(list_transform(string_split(text, chr(10)), lambda x: length({collapsed("x")}))) AS longest FROM t WHERE trim(t) <> '')
SELECT doc_id, page, 'references_body_translated' AS rule FROM y WHERE {n_of("t", CJK)} >= 10 AND y >= 2 UNION ALL SELECT doc_id, page, 'references_entries_merged' FROM y WHERE y >= 4 AND longest >= 360""")
def references_at_fault(spark, sf_dir):
    return rulebook.reference_faults(_pages(spark, sf_dir))


_TABLES, _TRACKED = ("Sub-corpus and Tokens", "Table 1: texts", "number of texts; mean length", "none", "Tokenss", None, "Table 2"), ("子语料库 here", "Table 1", "nothing", "表 2", "Mean length", None)


@query(f"""WITH v(kind, source, target) AS (VALUES {", ".join(f"({quoted(k)}, {quoted(s)}, {quoted(t)})" for k, s, t in rulebook.TABLE_TEXTS)}), p AS (SELECT o_custkey AS doc_id, (o_orderkey % 3)::INT AS page, coalesce({picked_sql("o_orderkey", _TABLES)}, '') AS text FROM orders), t AS (SELECT o_custkey AS doc_id, coalesce({picked_sql("o_orderkey // 2", _TRACKED)}, '') AS text FROM orders WHERE o_orderkey % 5 = 0),
h AS (SELECT DISTINCT doc_id, source FROM t JOIN v ON regexp_matches(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(source) || '(?:[^\\p{{L}}\\p{{N}}_]|$)') OR contains(text, target))
SELECT p.doc_id, p.page, 'table_' || kind || '_' || CASE WHEN h.doc_id IS NOT NULL THEN 'writeback_failed' WHEN kind = 'header' THEN 'missing_from_il' ELSE 'missing' END AS rule, v.source AS evidence FROM p JOIN v ON regexp_matches(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(v.source) || '(?:[^\\p{{L}}\\p{{N}}_]|$)') LEFT JOIN h ON h.doc_id = p.doc_id AND h.source = v.source""")
def table_texts_dropped(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("half", F.expr("o_orderkey div 2"))
    p = o.select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 3).cast("int").alias("page"), picked("o_orderkey", _TABLES).alias("text"))
    return rulebook.dropped_table_texts(p, o.where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("doc_id"), picked("half", _TRACKED).alias("text")))


_LABELS = ("AI", "a@b.c", "12.5%", "site.org", "GPT o3mini", "Smith", "MT vs. HT", "two words", "", None, "lower", "doi:1")


@query(f"""WITH a AS (SELECT doc_id, trim(coalesce(s, '')) AS s FROM {cases_sql("documents", "doc_id", _LABELS)}) SELECT doc_id, CASE WHEN s = '' THEN 'residual' WHEN contains(s, '@') OR contains(s, '://') OR starts_with(lower(s), 'doi') OR starts_with(lower(s), 'http') OR {has("s", r"^\d+(?:\.\d+)?%?$")} OR {has("s", r"^[A-Za-z0-9_.%+-]+\.[A-Za-z]{2,}(?:\.[A-Za-z]{2,})?$")}
 OR s IN ('AI', 'ML', 'NLP', 'GPU', 'CPU', 'API', 'LLM', 'GPT', 'R&D', 'EU', 'US', 'UK', 'OECD', 'UN', 'GDP', 'STEM') OR {has("s", r"^(?:OpenAI|GPT|ChatGPT)\s+o?\d+[A-Za-z]*$")} THEN 'allowed' WHEN {has("s", r"^[A-Z][A-Za-z'’.-]{1,24}$")} OR ({has("s", r"(?i)\bvs\.?\b")} AND {has("s", r"(?i)\b(?:HT|MT|NMT|LLM|GPT|AI)\b")}) THEN 'neutral' ELSE 'residual' END AS kind FROM a""")
def compact_labels(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", _LABELS).select("doc_id", rulebook.compact_label_kind(F.col("s")).alias("kind"))


# --- protected spans --------------------------------------------------------------------------------

_SPANNED = (
    "See https://a.org/x, and https://a.org/x. Also 10.1234/ab.c; [1, 2] $x_1$ then",
    "Use my_var and CamelCase in `code_a` with \\textbf{my_var} ABC",
    "[Smith et al., 2020] said AB1 and https://b.org/CamelCase",
    "```\ncode my_var\n```",
    "plain words only",
    "CamelCase CamelCase `x` `x` doi 10.5555/XYZ. \\cite[a]{b}",
)
_KINDS = (
    ("url", r"https?://[^\s)>\]]+"), ("doi", r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+"), ("citation", r"\[(?:\d+|[A-Z][A-Za-z-]+(?:\s+et\s+al\.)?,?\s+\d{4})(?:\s*[,;]\s*(?:\d+|[A-Z][A-Za-z-]+(?:\s+et\s+al\.)?,?\s+\d{4}))*\]"), ("inline_math", r"\$[^$\n]{1,240}\$"),
    ("latex_command", r"\\[A-Za-z]+(?:\*|\[[^\]]{0,120}\]|\{[^{}]{0,160}\})*"), ("inline_code", r"`[^`\n]{1,200}`"), ("variable", r"\b(?:[A-Za-z]+_[A-Za-z0-9_]+|[A-Za-z]+[A-Z][A-Za-z0-9]*|[A-Z]{2,}[A-Za-z0-9]*)\b"),
)


def _spans_sql() -> str:
    parts = [f"b AS (SELECT doc_id, s AS text, starts_with(s, '```') AS code FROM {cases_sql('documents', 'doc_id', _SPANNED)})"]
    for k, (kind, pattern) in enumerate(_KINDS):
        value = "regexp_replace(m[i], '[.,;:]+$', '')" if kind in ("url", "doi") else "m[i]"
        parts.append(f"m{k} AS (SELECT doc_id, regexp_extract_all(text, {quoted(pattern)}) AS m, string_split_regex(text, {quoted(pattern)}) AS g FROM b WHERE NOT code)")
        parts.append(f"c{k} AS (SELECT doc_id, {value} AS value, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS n FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m{k}))")
        before = " UNION ALL ".join(f"SELECT doc_id, s, e FROM a{j}" for j in range(k)) or "SELECT NULL::BIGINT AS doc_id, 0::HUGEINT AS s, 0::HUGEINT AS e WHERE false"
        parts.append(f"a{k} AS (SELECT doc_id, {k} AS k, {quoted(kind)} AS kind, value, s, s + n AS e FROM c{k} c WHERE NOT EXISTS (SELECT 1 FROM ({before}) t WHERE t.doc_id = c.doc_id AND t.s < c.s + c.n AND c.s < t.e) QUALIFY row_number() OVER (PARTITION BY doc_id, value ORDER BY s) = 1)")
    taken = " UNION ALL ".join(f"SELECT * FROM a{k}" for k in range(len(_KINDS)))
    return f"""WITH {', '.join(parts)}, t AS ({taken} UNION ALL SELECT doc_id, 0, 'code_block', text, 0, length(text) FROM b WHERE code)
SELECT doc_id, printf('PTS_%04d', row_number() OVER (PARTITION BY doc_id ORDER BY k, s)) AS span_id, kind, value, 'block-0001' AS block_id, s::BIGINT AS start, e::BIGINT AS "end" FROM t"""


@query(_spans_sql())
def protected_spans_made(spark, sf_dir):
    b = cases(spark, sf_dir, "documents", "doc_id", _SPANNED)
    b = b.select("doc_id", F.lit(1).alias("pos"), F.lit("block-0001").alias("block_id"), F.lit(1).alias("page"), F.col("s").alias("text"), F.when(F.col("s").startswith("```"), "code").otherwise("paragraph").alias("element_type"))
    return spans.protected_spans(b).drop("page")


# --- residue of the source's language ---------------------------------------------------------------

_RESIDUE = ("这里 method 有 several performance 以及 OpenAI 和 number of texts", "联系 someone@site.org 或 other 访问 github.com/owner-name/repo x", "plain continuing 与 captions 和 learning 也 attention", "中 memory", None, "doi.org/abc 与 environments 之后" + "，" * 60 + " evaluation trajectory", "Large LanguageModels 和 trajectories")
_FIELDS = ("trajectory", "Self-Attention"), ("method",)


def _residue_sql() -> str:
    word = r"[A-Za-z][A-Za-z-]{2,}"
    must, stay, need = ("(" + ", ".join(map(quoted, x)) + ")" for x in (terms.MUST_TRANSLATE, terms.MAY_STAY, terms.NEED_POLICY))
    return f"""WITH b AS (SELECT doc_id, coalesce(s, '') AS text FROM {cases_sql("documents", "doc_id", _RESIDUE)}), m AS (SELECT doc_id, text, regexp_extract_all(text, '{word}') AS m, string_split_regex(text, '{word}') AS g FROM b),
w AS (SELECT doc_id, text, i, m[i] AS word, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
c AS (SELECT *, lower(word) AS low, substr(text, greatest(1, s - 15)::BIGINT, least(16, s)::BIGINT) AS before, substr(text, (s + length(word) + 1)::BIGINT, 32) AS after, lower(substr(text, greatest(1, s - 47)::BIGINT, (least(48, s) + length(word) + 48)::BIGINT)) AS near FROM w),
k AS (SELECT doc_id, i, word, CASE WHEN low IN {must} THEN 'must_translate' WHEN word IN ({", ".join(map(quoted, _FIELDS[1]))}) OR low IN {stay} OR (contains(after, '@') AND NOT {has("split_part(after, '@', 1)", CJK)}) OR (contains(before, '@') AND NOT {has("split_part(before, '@', -1)", CJK)}) OR {has("near", r"https?://|www\.|github\.com|gitlab\.com|doi\.org")} OR (contains(word, '-') AND contains(near, 'bitbucket.org')) THEN 'allowed_keep'
 WHEN low IN {need} OR contains('trajectory', low) OR contains('self-attention', low) THEN 'needs_term_policy' WHEN {has("word", "^[A-Z]")} THEN 'allowed_keep' WHEN length(word) >= 8 THEN 'must_translate' END AS bucket FROM c)
SELECT doc_id, bucket, string_agg(word, ',' ORDER BY i) AS words FROM (SELECT doc_id, bucket, word, min(i) AS i FROM k WHERE bucket IS NOT NULL GROUP BY ALL) GROUP BY doc_id, bucket"""


@query(_residue_sql())
def residue_buckets(spark, sf_dir):
    d = cases(spark, sf_dir, "documents", "doc_id", _RESIDUE).withColumnRenamed("s", "text")
    out = terms.english_residue(d, spark.createDataFrame([(v,) for v in _FIELDS[1]], "value string"), spark.createDataFrame([(t,) for t in _FIELDS[0]], "term string"))
    return out.select("doc_id", "bucket", F.array_join("words", ",").alias("words"))


# --- terms of documents -----------------------------------------------------------------------------

_TITLED = "# Notes on LitLLMs and Deep Model Design\nAbstract\nThe RAG system uses OpenThing with the Literature Review of AI Index data\nIntroduction\nKeywords: textbase, Large Language Models\n"


def _terms_sql() -> str:
    doc = f"(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {quoted(_TITLED)} || text ELSE text END AS text FROM documents)"
    split = r"list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '%s'))"
    phrase = r"(?:[A-Z][a-z]+|[A-Z]{2,}s?)(?:[ \t]+(?:of|for|and|in|to|the|with|[A-Z][a-z]+|[A-Z]{2,}s?)){1,5}"
    doubled = r"regexp_replace(t, '([^\p{L}\p{N}_])', '\1\1', 'g')"
    phrases = rf"list_transform(regexp_extract_all({doubled}, '(?:^|[^\p{{L}}\p{{N}}_])({phrase})(?:[^\p{{L}}\p{{N}}_]|$)', 1), lambda x: replace(x, '  ', ' '))"
    low = ", ".join(quoted(t.lower()) for t in terms.STOP_TERMS)
    stop = ", ".join(quoted(p.lower()) for p in T.STOP_PHRASES)
    w = "string_split(lower(term), ' ')"
    known = ", ".join(f"({i}, {quoted(t)}, {quoted(tr)}, {quoted(a)}, {quoted(c)}, {quoted(ty)})" for i, (t, tr, a, c, ty) in enumerate(terms.KNOWN_TERMS))
    return rf"""WITH k(i, name, translation, action, confidence, type) AS (VALUES {known}), d AS (SELECT doc_id, concat_ws(chr(10), regexp_extract(text, '(?:^|\n)[# \t\r]*([^\s#][^\n]*?)[# \t\r]*(?:\n|\z)', 1), regexp_extract(text, '(?is)(?:^|\n)\s*(?:#+\s*)?abstract\s*\n(.*?)(?:\n\s*(?:#+\s*)?(?:introduction|1\.|keywords?)\b|\z)', 1), regexp_extract(text, '(?im)^Keywords?\s*[:：]\s*(.+)$', 1), substr(text, 1, 6000)) AS t FROM {doc}),
l AS (SELECT doc_id, 1 AS o, 'acronym' AS kind, {split % '[A-Z][A-Z0-9]+s?'} AS m FROM d UNION ALL SELECT doc_id, 2, 'camel', {split % '[A-Z][A-Za-z]+[A-Z][A-Za-z0-9]*'} FROM d UNION ALL SELECT doc_id, 3, 'phrase', {phrases} FROM d),
c AS (SELECT doc_id, o, kind, raw, count(*) AS n, min(i) AS first FROM (SELECT doc_id, o, kind, unnest(m) AS raw, generate_subscripts(m, 1) AS i FROM l) GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY n DESC, first) AS place FROM c QUALIFY place <= CASE kind WHEN 'acronym' THEN 40 WHEN 'camel' THEN 30 ELSE 60 END),
f AS (SELECT doc_id, o, kind, n, place, regexp_replace(trim(regexp_replace(raw, '\s+', ' ', 'g')), '^[ ,.;:()\[\]{{}}]+|[ ,.;:()\[\]{{}}]+$', '', 'g') AS term FROM p WHERE kind <> 'phrase' OR len(string_split_regex(raw, '\s+')) <= 6),
g AS (SELECT * FROM f WHERE length(term) >= 2 AND lower(term) NOT IN ({low}) AND NOT regexp_matches(term, '^(?:Abstract|Introduction|Conclusion|References|Keywords) ') AND NOT regexp_matches(term, '\b[A-Z]{{2,}}s?\s+for\s+') AND (term IN (SELECT name FROM k) OR NOT (lower(term) IN ({stop}) OR {w}[1] IN ('the','this','these','in','on','for','with','using') OR {w}[-1] IN ('and','or','with','of','the','in','for','to')
 OR (len({w}) <= 2 AND list_has_any({w}, ['the','this','these','in','on','for','with','using','and','or','of','to'])) OR regexp_full_match(term, '(?:[A-Z][a-z]+\s+){{0,2}}(?:Proceedings|Transactions|Journal|Conference|Workshop)\s+of\s+the')))),
x AS (SELECT doc_id, name AS term, i FROM d JOIN k ON regexp_matches(t, '(?:^|[^A-Za-z0-9])' || regexp_escape(name) || '(?:[^A-Za-z0-9]|$)')),
u AS (SELECT doc_id, term, arg_min(kind, o * 1000 + place) AS kind, arg_min(n, o * 1000 + place) AS n, max((o = 9)::INT) AS known FROM (SELECT doc_id, term, kind, n, o, place FROM g UNION ALL SELECT doc_id, term, 'known', -1, 9, i FROM x) GROUP BY doc_id, term),
r AS (SELECT u.*, k.* FROM u LEFT JOIN k ON u.term = k.name AND known = 1 WHERE known = 1 OR NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = u.doc_id AND contains(x.term, u.term)))
SELECT doc_id, term, kind, nullif(n, -1) AS n, coalesce(translation, '') AS translation, coalesce(action, 'decide') AS action, coalesce(confidence, 'medium') AS confidence, coalesce(type, CASE WHEN regexp_full_match(term, '[A-Z][A-Z0-9]+s?') THEN 'abbreviation' WHEN regexp_full_match(term, '[A-Z][A-Za-z]+[A-Z][A-Za-z0-9]*') THEN 'name' WHEN regexp_matches(lower(term), 'journal|proceedings|conference|workshop|transactions') THEN 'publication' WHEN regexp_matches(lower(term), 'university|institute|laboratory|department') THEN 'organization' ELSE 'concept' END) AS term_type,
 row_number() OVER (PARTITION BY doc_id ORDER BY known DESC, lower(term), term) AS rank FROM r QUALIFY rank <= 80"""


@query(_terms_sql())
def term_table(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(_TITLED), "text")).otherwise(F.col("text")).alias("text"))
    return terms.candidate_terms(d).withColumn("rank", F.col("rank").cast("long"))


# --- lists, back matter, pixels, layout maps --------------------------------------------------------

_ITEMS, _ROWS = ("1. first item", "2) second item", "plain", "3.no space", None), ("1. 甲 2. 乙", "1. 甲", "无", "3) a 3) b", "x 4. y 5) z")


@query(f"""WITH s AS (SELECT o_custkey // 10 AS doc_id FROM orders WHERE {has(picked_sql("o_orderkey", _ITEMS), r"^\s*[1-9][.)]\s+")} AND o_orderkey % 4 = 0 GROUP BY 1 HAVING count(*) >= 2), t AS (SELECT o_custkey // 10 AS doc_id, (o_orderkey % 3)::INT AS page, o_orderkey AS line_index, {picked_sql("o_orderkey // 2", _ROWS)} AS text FROM orders WHERE o_orderkey % 7 = 0)
SELECT * FROM t WHERE doc_id IN (SELECT doc_id FROM s) AND len(list_distinct(regexp_extract_all(text, '(?:^|\\s)([1-9][.)])\\s+', 1))) >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page, line_index) = 1""")
def merged_items(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("half", F.expr("o_orderkey div 2"))
    key = [F.expr("o_custkey div 10").alias("doc_id"), (F.col("o_orderkey") % 3).cast("int").alias("page"), F.col("o_orderkey").alias("line_index")]
    return spatial.merged_list_items(o.where("o_orderkey % 4 = 0").select(*key, picked("o_orderkey", _ITEMS).alias("text")), o.where("o_orderkey % 7 = 0").select(*key, picked("half", _ROWS).alias("text")))


_BACK = ("ACKNOWLEDGEMENTS", "致谢", "作者贡献和利益冲突", "plain", None, "Informed consent was given", "出版方声明", "nothing")


@query(f"""WITH l AS (SELECT o_custkey AS doc_id, coalesce({picked_sql("o_orderkey", _BACK)}, '') AS t FROM orders WHERE o_orderkey % 15 >= 10), s AS (SELECT doc_id, [{", ".join(f"max(contains(lower(t), {quoted(m.lower())})::INT)" for m in spatial.BACK_MATTER)}] AS e, [{", ".join(f"max(contains(t, {quoted(m)})::INT)" for m in spatial.BACK_MATTER_TRANSLATED)}] AS z FROM l GROUP BY doc_id), n AS (SELECT doc_id, list_sum(e)::BIGINT AS n_english, list_sum(z)::BIGINT AS n_translated FROM s)
SELECT *, CASE WHEN n_english > 0 AND n_translated > 0 THEN 'mixed' WHEN n_english > 0 THEN 'english_visible' WHEN n_translated >= 3 THEN 'translated_visible' ELSE 'unknown' END AS status FROM n""")
def back_matter_shown(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return spatial.back_matter(o.select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 15).alias("page"), picked("o_orderkey", _BACK).alias("text")))


@query("""WITH p AS (SELECT l_suppkey AS doc_id, l_linenumber AS page, (l_partkey % 256) AS r, (l_orderkey % 256) AS g, (l_quantity::BIGINT * 5 % 256) AS b FROM lineitem) SELECT doc_id, page, count(*) AS n, round(count(*) FILTER (WHERE least(r, g, b) < 245) / count(*), 4) AS nonwhite_ratio, round(count(*) FILTER (WHERE greatest(r, g, b) - least(r, g, b) >= 18 AND least(r, g, b) < 245) / count(*), 4) AS colored_ratio, count(DISTINCT (r, g, b)) AS n_colors FROM p GROUP BY doc_id, page""")
def page_pixels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return spatial.pixel_ratios(li.select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 256).alias("r"), (F.col("l_orderkey") % 256).alias("g"), (F.col("l_quantity").cast("long") * 5 % 256).alias("b")))


_IN, _OUT = ("Some text", "Other words", "", None, "SAME"), ("一些 words 文", "Other  words", "译文", None, "same")
_MAPPED = f"(SELECT o_custkey AS doc_id, o_orderkey AS nth, CASE WHEN o_orderkey % 2 = 0 THEN 'page' END AS g, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 END AS page, CASE WHEN o_orderkey % 4 = 0 THEN 'd' || o_orderkey::VARCHAR END AS debug, CASE WHEN o_orderkey % 5 = 0 THEN 'l' ELSE '' END AS layout, CASE WHEN o_orderkey % 6 = 0 THEN 'title' END AS label, coalesce({picked_sql('o_orderkey', _IN)}, '') AS s, coalesce({picked_sql('o_orderkey', _OUT)}, '') AS o, o_orderkey % 11 = 0 AS fallback FROM orders)"
_STATUS = f"CASE WHEN fallback THEN 'fallback_to_translate' WHEN s <> '' AND o <> '' AND {normal('s')} = {normal('o')} THEN 'same_as_input' WHEN {has('o', CJK)} AND {has('o', '[A-Za-z]{3,}')} THEN 'mixed_or_partial_output' ELSE 'translated_or_passthrough' END"


def _mapped(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    return spatial.layout_map(o.select(F.col("o_custkey").alias("doc_id"), k.alias("nth"), F.when(k % 2 == 0, "page").alias("tracking_group"), F.when(k % 3 > 0, k % 3).alias("page"), F.when(k % 4 == 0, F.concat(F.lit("d"), k.cast("string"))).alias("debug_id"), F.when(k % 5 == 0, "l").otherwise("").alias("layout_id"), F.when(k % 6 == 0, "title").alias("layout_label"), picked("o_orderkey", _IN).alias("input"), picked("o_orderkey", _OUT).alias("output"), (k % 11 == 0).alias("fallback")))


@query(f"""SELECT nth, coalesce(g, 'tracking') || ':p' || coalesce(page::VARCHAR, 'None') || CASE WHEN debug IS NOT NULL THEN ':debug:' || debug WHEN layout <> '' THEN ':layout:' || layout ELSE printf(':order:%04d', nth) END AS engine_block_id, {_STATUS} AS fallback_status FROM {_MAPPED}""")
def layout_blocks(spark, sf_dir):
    return _mapped(spark, sf_dir)[0].select("nth", "engine_block_id", "fallback_status")


@query(f"""SELECT doc_id, count(*) AS n_blocks, round(avg((label IS NOT NULL)::INT), 3) AS label_coverage, round(avg(({_STATUS} <> 'translated_or_passthrough')::INT), 3) AS fallback_ratio FROM {_MAPPED} GROUP BY doc_id""")
def layout_shares(spark, sf_dir):
    return _mapped(spark, sf_dir)[1]
