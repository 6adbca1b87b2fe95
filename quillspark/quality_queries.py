"""Queries of roll-ups, gates, findings and rewrites of rows, over orders, lines, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import quality, rewrites
from .registry import picked, picked_sql, query, quoted, table
from .text_queries import CJK, MIXED, _needs, _partial, _passes, _same, _visible, english, has, n_of, normal, shown, words

_SEVERITY = ("high", "medium", "low")


@query(f"""WITH i AS (SELECT l_orderkey AS block_id, {picked_sql("l_partkey", _SEVERITY)} AS severity, 'fix ' || l_linestatus AS repair, l_returnflag || l_linenumber::VARCHAR AS title FROM lineitem), k AS (SELECT * FROM i WHERE severity <> 'low')
SELECT block_id, array_to_string(list_sort(list_distinct(list(repair))), ',') AS repairs, string_agg(severity || ':' || title, ',' ORDER BY severity, title) AS issues FROM k GROUP BY block_id""")
def affected_orders(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block_id"), picked("l_partkey", _SEVERITY).alias("severity"), F.concat(F.lit("fix "), "l_linestatus").alias("repair"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("title"))
    out = quality.affected(i)
    return out.select("block_id", F.array_join("repairs", ",").alias("repairs"), F.array_join(F.transform("issues", lambda x: F.concat(x["severity"], F.lit(":"), x["title"])), ",").alias("issues"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_orders(spark, sf_dir):
    return quality.keep_first(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""WITH h AS (SELECT l_orderkey AS doc_id, list_distinct(list(l_linenumber)) AS have FROM lineitem GROUP BY l_orderkey), t AS (SELECT o_orderkey AS doc_id, o_orderkey % 9 AS n_pages FROM orders),
m AS (SELECT t.doc_id, n_pages, list_filter(range(1, n_pages + 1), lambda p: NOT list_contains(coalesce(have, []), p)) AS missing FROM t LEFT JOIN h USING (doc_id))
SELECT doc_id, n_pages, array_to_string(missing, ',') AS missing_pages, round((n_pages - len(missing)) / greatest(1, n_pages), 3) AS coverage, CASE WHEN (n_pages - len(missing)) * 2 < n_pages THEN 'fail' WHEN len(missing) > 0 THEN 'warn' ELSE 'ok' END AS status FROM m""")
def pages_covered(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"))
    totals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 9).alias("n_pages"))
    return quality.page_coverage(pages, totals).select("doc_id", "n_pages", F.array_join(F.transform("missing_pages", lambda p: p.cast("string")), ",").alias("missing_pages"), "coverage", "status")


_CUT = "substr(text, 1, (doc_id % 5 * 50)::INT)"


@query(f"""SELECT s.doc_id, 1 AS page, CASE WHEN coalesce(length(t.text), 0) = 0 THEN 'blank' WHEN length(s.text) >= 20 AND coalesce(length(t.text), 0) < greatest(20, 0.08::DOUBLE * length(s.text)) THEN 'low' ELSE 'ok' END AS status FROM documents s LEFT JOIN (SELECT doc_id, {_CUT} AS text FROM documents WHERE doc_id % 7 <> 0) t USING (doc_id)""")
def thin_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    cut = d.where("doc_id % 7 <> 0").withColumn("text", F.expr("substring(text, 1, cast(doc_id % 5 * 50 as int))"))
    return quality.document_coverage(d, cut).select("doc_id", "page", "status")


_LATEX_SOURCE = ("\\textbf{a} \\cite{b} and text", "plain https://a.org/x and 10.1234/ab", "word " * 150 + "letters " * 20, "\\cite{a} \\cite{b}", None)
_LATEX_TARGET = ("\\textbf{甲} 和", "普通 https://a.org/x", "短", "\\cite{a} {未闭合", "", "文 \\cite{a} \\cite{b} \\{", None)
_SEGMENTS = f"(SELECT o_orderkey AS segment_id, {picked_sql('o_orderkey', _LATEX_SOURCE)} AS source, {picked_sql('o_orderkey', _LATEX_TARGET)} AS target FROM orders)"


def _segments(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment_id"), picked("o_orderkey", _LATEX_SOURCE).alias("source"), picked("o_orderkey", _LATEX_TARGET).alias("target"))


def _commands(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '\\\\[A-Za-z]+')"


@query(f"""WITH a AS (SELECT segment_id, coalesce(source, '') AS s, coalesce(target, '') AS t, {_commands("source")} AS cs, {_commands("target")} AS ct FROM {_SEGMENTS}),
b AS (SELECT segment_id, list_sort(list_filter(list_distinct(cs), lambda x: len(list_filter(cs, lambda y: y = x)) > len(list_filter(ct, lambda y: y = x)))) AS lost, length(regexp_replace(t, '\\\\[{{}}]', '', 'g')) AS ignored,
 {n_of("replace(replace(t, chr(92) || '{', ''), chr(92) || '}', '')", "[{]")} <> {n_of("replace(replace(t, chr(92) || '{', ''), chr(92) || '}', '')", "[}]")} AS unbalanced, {n_of("s", "[A-Za-z]")} >= 600 AND len({words("s")}) >= 90 AND length(t) < greatest(80::DOUBLE, 0.22::DOUBLE * len({words("s")})) AS incomplete FROM a)
SELECT segment_id, array_to_string(lost, '|') AS lost_commands, unbalanced, incomplete, CASE WHEN unbalanced OR incomplete THEN 'blocking' WHEN len(lost) > 0 THEN 'warn' ELSE 'ok' END AS status FROM b""")
def segment_gates(spark, sf_dir):
    out = quality.segment_gate(_segments(spark, sf_dir))
    return out.withColumn("lost_commands", F.array_join(F.array_sort("lost_commands"), "|"))


def _links(x: str) -> str:
    return f"list_distinct(regexp_extract_all(coalesce({x}, ''), 'https?://[^\\s{{}}]+|10\\.\\d{{4,9}}/[-._;()/:A-Za-z0-9]+'))"


@query(f"""SELECT segment_id, trim(coalesce(target, '')) = '' AS empty, array_to_string(list_sort(list_filter({_links("source")}, lambda x: NOT list_contains({_links("target")}, x))), '|') AS missing_links FROM {_SEGMENTS}""")
def lost_content(spark, sf_dir):
    return quality.content_loss(_segments(spark, sf_dir)).withColumn("missing_links", F.array_join(F.array_sort("missing_links"), "|"))


_BADGES = (("rich", "BUILDING", 5000.0), ("debt", "MACHINERY", -500.0), ("any", "BUILDING", 0.0), ("none", "UNKNOWN", 1.0))


@query(f"""WITH r(badge, counter, least) AS (VALUES {", ".join(f"({quoted(b)}, {quoted(c)}, {v}::DOUBLE)" for b, c, v in _BADGES)}) SELECT DISTINCT c_custkey AS user_id, badge FROM customer JOIN r ON counter = c_mktsegment WHERE c_acctbal >= least""")
def earned_badges(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("counter"), F.col("c_acctbal").alias("value"))
    return quality.badges(c, spark.createDataFrame(list(_BADGES), "badge string, counter string, least double"))


# --- pages of a source and its translation: lines of orders ----------------------------------------

_ENGLISH = ("This paragraph shows how the model keeps its memory across many tasks", "我们提出了一种新的方法来改进这些任务的表现和记忆", "REPORT 2021", "Introduction 12", "AI INDEX", "another methods section with seven plain words left", "目录 3", "in 1999 and 20011", "References", None, "Learning 4")
_CHINESE = ("我们提出了一种新的方法", "报告 2021", "引言 12", "目录 3", "", "AI INDEX", "学习 4", None, "1999")
_LINES = f"(SELECT o_custkey // 10 AS doc_id, (o_orderkey % 5)::INT AS page, o_orderkey AS line_index, {picked_sql('o_orderkey', _ENGLISH)} AS text FROM orders)"
_MADE = f"(SELECT o_custkey // 10 AS doc_id, (o_orderkey % 5)::INT AS page, o_orderkey AS line_index, {picked_sql('o_orderkey // 2', _CHINESE)} AS text FROM orders WHERE o_orderkey % 3 <> 0)"


def _lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("half", F.expr("o_orderkey div 2"))
    key = [F.expr("o_custkey div 10").alias("doc_id"), (F.col("o_orderkey") % 5).cast("int").alias("page"), F.col("o_orderkey").alias("line_index")]
    return o.select(*key, picked("o_orderkey", _ENGLISH).alias("text")), o.where("o_orderkey % 3 <> 0").select(*key, picked("half", _CHINESE).alias("text"))


@query(f"""WITH r AS (SELECT doc_id, min(page) AS ref FROM {_LINES} WHERE lower(trim(text)) IN ('references', 'bibliography', '参考文献') AND page > 3 GROUP BY doc_id), l AS (SELECT * FROM {_LINES} WHERE NOT (lower(trim(coalesce(text, ''))) IN ('references', 'bibliography', '参考文献') AND page <= 3)),
m AS (SELECT l.*, coalesce({english("text")} AND NOT {has("text", CJK)} AND NOT {shown("text")}, false) AS en, len({words("coalesce(text, '')", 4)}) AS w, {n_of("coalesce(text, '')", CJK)} AS c FROM l LEFT JOIN r USING (doc_id) WHERE ref IS NULL OR page < ref),
p AS (SELECT doc_id, page FROM m GROUP BY doc_id, page HAVING (count(*) FILTER (WHERE en) >= 3 OR sum(CASE WHEN en THEN w ELSE 0 END) >= 25) AND sum(c) >= 20),
h AS (SELECT m.* FROM m JOIN p USING (doc_id, page) WHERE en QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY line_index) <= 4)
SELECT doc_id, page, line_index, text FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page, line_index) <= 10""")
def english_left_on_pages(spark, sf_dir):
    lines = _lines(spark, sf_dir)[0].where("not (lower(trim(coalesce(text, ''))) = 'references' and page <= 3)")
    return quality.having_pages(lines, per_page=4, most=10, least_lines=3, least_words=25)


@query(f"""WITH e AS (SELECT * FROM {_LINES} WHERE page <= 3), y AS (SELECT doc_id, page, unnest(list_filter(regexp_extract_all(coalesce(text, ''), '\\d+'), lambda x: regexp_full_match(x, '(?:19|20)\\d{{2}}'))) AS key FROM e), u AS (SELECT doc_id, page, trim(text) AS key FROM e WHERE text = upper(text) AND {has("text", "[A-Z]{3,}")}),
k AS (SELECT doc_id, key, min(page) AS page FROM (SELECT * FROM y UNION ALL SELECT * FROM u) GROUP BY doc_id, key QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(page), key) <= 12), w AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page, line_index) AS body FROM {_MADE} GROUP BY doc_id)
SELECT k.doc_id, key, page FROM k LEFT JOIN w USING (doc_id) WHERE NOT contains(coalesce(body, ''), key)""")
def lost_key_texts(spark, sf_dir):
    return quality.key_texts_missing(*_lines(spark, sf_dir))


_CONTENTS = "SELECT doc_id, page, count(*) AS n, coalesce(list(try_cast(regexp_extract(coalesce(text, ''), '(\\d{{1,3}})\\s*$', 1) AS INT) ORDER BY line_index) FILTER (WHERE regexp_extract(coalesce(text, ''), '(\\d{{1,3}})\\s*$', 1) <> ''), []) AS v FROM {} GROUP BY doc_id, page"


@query(f"""WITH s AS ({_CONTENTS.format(_LINES)}), t AS ({_CONTENTS.format(_MADE)})
SELECT s.doc_id, s.page, s.n AS s_lines, t.n AS t_lines, coalesce(t.n, 0) * 2 < s.n OR len(coalesce(t.v, [])) * 2 < len(s.v) AS dropped, coalesce(t.v <> list_sort(t.v), false) AS unsorted FROM s LEFT JOIN t ON s.doc_id = t.doc_id AND s.page = t.page""")
def contents_kept(spark, sf_dir):
    return quality.toc_preserved(*_lines(spark, sf_dir)).select("doc_id", "page", "s_lines", "t_lines", "dropped", "unsorted")


_PEOPLE = ("Anna Smith, Bob Jones; Carla M. Diaz", "Department of Physics, Dan O'Neil-Brown", "no names here", "Eve Adams and Frank Castle", None, "Table One, Gina Hall Report")
_NAME = r"^[A-Z][a-z]+(?:[-''][A-Z]?[a-z]+)?(?: (?:[A-Z]\.|[A-Z][a-z]+(?:[-''][A-Z]?[a-z]+)?)){1,4}$"


def _names(x: str) -> str:
    w = "string_split_regex(trim(p), '\\s+')"
    windows = f"flatten(list_transform(string_split_regex(coalesce({x}, ''), '[,;\\n]'), lambda p: flatten(list_transform([2, 3, 4, 5], lambda k: list_transform(range(1, greatest(len({w}) - k + 2, 1)), lambda i: array_to_string({w}[i:i + k - 1], ' '))))))"
    return f"list_sort(list_distinct(list_filter({windows}, lambda n: regexp_matches(n, '{_NAME}') AND NOT regexp_matches(n, '\\b(?:University|Institute|Department|Table|Figure|Chapter|Report|Index)\\b'))))"


@query(f"SELECT o_orderkey, array_to_string({_names('s')}, '|') AS names FROM (SELECT o_orderkey, {picked_sql('o_orderkey', _PEOPLE)} AS s FROM orders)")
def people_named(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", picked("o_orderkey", _PEOPLE).alias("s"))
    return o.select("o_orderkey", F.array_join(F.array_sort(T.person_names(F.col("s"))), "|").alias("names"))


_KEPT_PEOPLE = ("Anna Smith 和 Bob Jones", "丹", "", "Eve Adams", "Gina Hall")


@query(f"""WITH a AS (SELECT o_orderkey AS doc_id, 1 AS page, {_names("s")} AS names, t FROM (SELECT o_orderkey, {picked_sql("o_orderkey", _PEOPLE)} AS s, {picked_sql("o_orderkey", _KEPT_PEOPLE)} AS t FROM orders)), b AS (SELECT *, list_filter(names, lambda n: NOT contains(t, n)) AS lost FROM a)
SELECT doc_id, page, array_to_string(lost, '|') AS lost FROM b WHERE len(names) >= 2 AND len(lost) >= 0.24::DOUBLE * len(names)""")
def people_lost(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), picked("o_orderkey", _PEOPLE).alias("s"), picked("o_orderkey", _KEPT_PEOPLE).alias("t"))
    out = quality.names_lost(o.select("doc_id", "page", F.col("s").alias("text")), o.select("doc_id", "page", F.col("t").alias("text")), least=2)
    return out.select("doc_id", "page", F.array_join(F.array_sort("lost"), "|").alias("lost"))


# --- findings ---------------------------------------------------------------------------------------

_TYPES, _VISIBLE = ("english_residue", "prompt_leak", "missing"), ("Plain words that were left here", "Introduction", "仅输出翻译", "model", "left over text of a body", None)
_LAYOUT = ("body_prose", "title", "", None, "plain text")
_FINDINGS = f"(SELECT o_custkey // 10 AS doc_id, {picked_sql('o_orderkey', _TYPES)} AS failure_type, (o_orderkey % 3)::INT AS page, {picked_sql('o_orderkey', _VISIBLE)} AS visible_text, printf('r%06d', o_orderkey) AS rule, CASE WHEN o_orderkey % 4 = 0 THEN 'blocking' ELSE 'warn' END AS severity, {picked_sql('o_orderkey', _LAYOUT)} AS layout_role FROM orders)"


def _findings(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.expr("o_custkey div 10").alias("doc_id"), picked("o_orderkey", _TYPES).alias("failure_type"), (k % 3).cast("int").alias("page"), picked("o_orderkey", _VISIBLE).alias("visible_text"), F.format_string("r%06d", k).alias("rule"), F.when(k % 4 == 0, "blocking").otherwise("warn").alias("severity"), picked("o_orderkey", _LAYOUT).alias("layout_role"))


@query(f"""WITH k AS (SELECT * FROM {_FINDINGS} WHERE NOT {shown("visible_text")} QUALIFY row_number() OVER (PARTITION BY doc_id, failure_type, page, visible_text ORDER BY rule) = 1)
SELECT doc_id, rule, page = 1 AS critical_page, severity = 'blocking' OR (page = 1 AND lower(coalesce(layout_role, '')) IN ('body_prose', 'plain text', 'text', 'paragraph_hybrid', 'unknown_visible_line', '')) OR failure_type = 'prompt_leak' AS delivery_blocking FROM k""")
def audited_residue(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return quality.residue_audit([f.where("rule < 'r000700'"), f.where("rule >= 'r000700'")]).select("doc_id", "rule", "critical_page", "delivery_blocking")


_REPAIRS = {"english_residue": "translate_rest", "missing": "restore"}


@query(f"""SELECT doc_id, printf('repair-%04d', row_number() OVER (PARTITION BY doc_id ORDER BY page, failure_type, visible_text NULLS FIRST, rule)) AS task_id, page, failure_type, CASE failure_type WHEN 'english_residue' THEN 'translate_rest' WHEN 'missing' THEN 'restore' ELSE 'manual_review' END AS repair_target FROM {_FINDINGS}""")
def repair_tasks(spark, sf_dir):
    return quality.repair_plan(_findings(spark, sf_dir), _REPAIRS)


@query(f"""WITH e AS (SELECT doc_id, rule, CASE WHEN rule IN ('r000001', 'r000010', 'r000100') AND severity = 'warn' THEN 'blocking' ELSE severity END AS severity FROM {_FINDINGS} WHERE rule < 'r000500')
SELECT * FROM e UNION ALL SELECT doc_id, rule, severity FROM {_FINDINGS} WHERE rule >= 'r000400' AND (doc_id, rule) NOT IN (SELECT (doc_id, rule) FROM e)""")
def escalated_findings(spark, sf_dir):
    f = _findings(spark, sf_dir).select("doc_id", "rule", "severity")
    have = quality.escalate(f.where("rule < 'r000500'"), ("r000001", "r000010", "r000100"))
    return quality.append_new(have, f.where("rule >= 'r000400'"), ["doc_id", "rule"])


@query("""WITH a AS (SELECT o_orderkey AS block_id, CASE WHEN o_orderkey % 3 = 0 THEN 'e' || o_orderkey::VARCHAR END AS engine_block_id, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 7)::INT END AS page, l_returnflag AS title, CASE l_returnflag WHEN 'R' THEN 'high' ELSE 'medium' END AS severity FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT DISTINCT block_id, title, severity, CASE WHEN engine_block_id IS NOT NULL THEN 'engine_block' WHEN page IS NOT NULL THEN 'page' ELSE 'full_document' END AS scope FROM a""")
def rerender_scopes(spark, sf_dir):
    k = F.col("o_orderkey")
    issues = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.when(F.col("l_returnflag") == "R", "high").otherwise("medium").alias("severity"), F.col("l_returnflag").alias("title"))).alias("issues"))
    o = table(spark, sf_dir, "orders").join(issues, k == F.col("l_orderkey")).select(k.alias("block_id"), F.when(k % 3 == 0, F.concat(F.lit("e"), k.cast("string"))).alias("engine_block_id"), F.when(k % 2 == 0, (k % 7).cast("int")).alias("page"), "issues")
    return quality.rerender_tasks(o).select("block_id", "title", "severity", "scope")


_RULES = ("protected_lost", "term_policy", "english_left", "drift", "residue")


@query(f"""WITH i AS (SELECT l_orderkey, l_linenumber, {picked_sql("l_partkey", _RULES)} AS rule, {picked_sql("l_suppkey", _SEVERITY)} AS severity FROM lineitem)
SELECT *, CASE WHEN {has("rule", "protect")} THEN 'restore_protected' WHEN {has("rule", "term|policy")} THEN 'apply_policy' WHEN {has("rule", "residue|english")} THEN 'translate_rest' ELSE 'review' END AS repair FROM i WHERE severity <> 'low'""")
def issue_checks(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", picked("l_partkey", _RULES).alias("rule"), picked("l_suppkey", _SEVERITY).alias("severity"))
    return quality.qa_checks(i)


@query("""WITH o AS (SELECT l_orderkey AS o_orderkey, 'part ' || min(l_partkey)::VARCHAR AS v FROM lineitem WHERE l_discount > 0.05 GROUP BY l_orderkey) SELECT o_orderkey, coalesce(v, o_orderstatus) AS o_orderstatus FROM orders LEFT JOIN o USING (o_orderkey)""")
def overridden_statuses(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    over = table(spark, sf_dir, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("pos"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("value"))
    return quality.override(o, over, ["o_orderkey"], "o_orderstatus")


_WORDS, _MESSAGES = ("Critical", "p1", "note", "WARNING", "p0", None), ("Font size too small 第 3 页", "english residue left p. 12", "text missing", "other", None, "overlap on page", "translated twice p.5")


@query(f"""WITH a AS (SELECT o_orderkey, lower(coalesce({picked_sql("o_orderkey", _WORDS)}, '')) AS s, coalesce({picked_sql("o_orderkey // 2", _MESSAGES)}, '') AS message, CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 30)::VARCHAR END AS page FROM orders), b AS (SELECT *, lower(message) AS m FROM a)
SELECT o_orderkey, CASE WHEN s IN ('blocking', 'critical', 'error', 'high', 'p0') THEN 'blocking' WHEN s IN ('warn', 'warning', 'medium', 'p1') THEN 'warn' ELSE 'info' END AS severity, CASE WHEN {has("m", "font|size|overlap|layout|position")} THEN 'layout' WHEN {has("m", "translat|residue|english")} THEN 'translation' WHEN {has("m", "missing|dropped|blank")} THEN 'writeback' ELSE 'unknown' END AS stage,
 coalesce(page::INT, try_cast(nullif(regexp_extract(message, '第\\s*(\\d+)\\s*页', 1), '') AS INT), try_cast(nullif(regexp_extract(message, 'p\\.\\s*(\\d+)', 1), '') AS INT)) AS page FROM b""")
def normal_findings(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("half", F.expr("o_orderkey div 2"))
    f = o.select("o_orderkey", picked("o_orderkey", _WORDS).alias("severity"), picked("half", _MESSAGES).alias("message"), F.when(F.col("o_orderkey") % 4 == 0, (F.col("o_orderkey") % 30).cast("string")).alias("page"))
    return quality.normalize_finding(f).select("o_orderkey", "severity", "stage", "page")


# --- translations of probes and ledgers -------------------------------------------------------------

_OUT = ("模型在任务上提升了性能", "我们提出了一种方法 with LLMs and 12 ％ 提升", "We need to translate this", "", "以下是根据您的要求", "https://example.org/a?b=1", "人工智能", "GPT-4o ", "{v1} 代码", None, "Hello world", "这里 https://x.org")
_EXPECTED = ("translate", "protect", "translate")
_TALK = r"(?i)\b(?:we\s+(?:need|are asked|required)|the\s+user\s+provides|given\s+the\s+text|task\s+is\s+to\s+translate)\b|(?:我们(?:需要|被要求|要做的是|的任务是)|用户(?:提供|给出)|给定的文本)"
_LEAK = r"(?i)以下是(?:根据|依据).*?(?:要求|翻译)|仅输出翻译|不要输出(?:解释|分析)|保留(?:占位符|拉丁)|论文级别术语|Translate ordinary English prose"
_CASES = f"(SELECT o_orderkey, {picked_sql('o_orderkey', MIXED)} AS source, {picked_sql('o_orderkey // 2', _OUT)} AS output, {picked_sql('o_orderkey', _EXPECTED)} AS expected_behavior FROM orders)"


def _probes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("half", F.expr("o_orderkey div 2"))
    return o.select("o_orderkey", picked("o_orderkey", MIXED).alias("source"), picked("half", _OUT).alias("output"), picked("o_orderkey", _EXPECTED).alias("expected_behavior"))


def _talks(x: str) -> str:
    return f"({has(_visible(x), _TALK)} OR {has(_visible(x), _LEAK)})"


@query(f"""SELECT o_orderkey, {_talks("output")} AS talks FROM {_CASES}""")
def task_talk(spark, sf_dir):
    return _probes(spark, sf_dir).select("o_orderkey", T.task_explanation(F.col("output")).alias("talks"))


@query(f"""WITH a AS (SELECT *, list_filter(regexp_extract_all(coalesce(source, ''), 'https?://[^\\s<>]+|\\{{v\\d+\\}}'), lambda t: NOT contains(coalesce(output, ''), t)) AS lost FROM {_CASES})
SELECT o_orderkey, CASE WHEN coalesce(output, '') = '' THEN 'empty_output' WHEN {_passes("source")} AND {normal("source")} = {normal("output")} THEN 'protected_passthrough' WHEN {_same("source", "output")} THEN 'same_as_input_or_non_chinese' WHEN {_partial("source", "output")} THEN 'partial_untranslated' WHEN {_talks("output")} THEN 'task_explanation' WHEN len(lost) > 0 THEN 'protected_value_missing' ELSE 'translated' END AS status FROM a""")
def ledger_statuses(spark, sf_dir):
    return _probes(spark, sf_dir).select("o_orderkey", quality.ledger_status(F.col("source"), F.col("output")).alias("status"))


@query(f"""WITH a AS (SELECT *, list_filter(list_distinct(regexp_extract_all(coalesce(source, ''), '\\{{v\\d+\\}}|</?style\\b[^>]*>|https?://[^\\s<>]+|10\\.\\d{{4,9}}/[-._;()/:A-Za-z0-9]+')), lambda t: NOT contains(coalesce(output, ''), t)) AS lost, expected_behavior = 'translate' AS tr FROM {_CASES}),
b AS (SELECT *, {_same("source", "output")} AS same, {_partial("source", "output")} AS part, {_talks("output")} AS talk, tr AND {_needs("source")} AND NOT coalesce({has("output", CJK)}, false) AND {has(_visible("output"), "[A-Za-z]{4,}")} AS non FROM a)
SELECT o_orderkey, same AND tr AS same_as_input, non AS non_chinese, part AND tr AS partial_untranslated, len(list_filter(lost, lambda t: regexp_full_match(t, '\\{{v\\d+\\}}'))) > 0 AS placeholder_break, len(list_filter(lost, lambda t: regexp_matches(t, '(?i)^</?style'))) > 0 AS style_tag_break, len(lost) > 0 AS protected_span_break, talk AS task_explanation,
 NOT tr AND NOT same AND {_visible("source")} <> {_visible("output")} AS protected_mistranslation, tr AND (same OR non OR part OR talk) AS ordinary_failure FROM b""")
def probe_flags(spark, sf_dir):
    return quality.classify_probe(_probes(spark, sf_dir)).select("o_orderkey", *quality.PROBE_FLAGS)


@query("""WITH a AS (SELECT o_orderkey AS run_id, o_orderkey % 40 AS n, o_orderkey % 4 AS f, o_orderkey % 5 AS j, o_orderkey % 7 AS s, o_orderkey % 3 AS c FROM orders), b AS (SELECT *, f / greatest(1, n) AS r FROM a)
SELECT run_id, n AS paragraphs, f AS fallbacks, j AS json_errors, s AS same, c AS cache_hits, 3::BIGINT AS calls, round(r, 4) AS fallback_ratio, round(c / 3, 4) AS hit_ratio, CASE WHEN r >= 0.15 OR j >= 3 OR s >= 3 THEN 'partial' WHEN r > 0.05 OR f + j + s > 0 THEN 'warn' ELSE 'ok' END AS status FROM b""")
def backend_logs(spark, sf_dir):
    k = F.col("o_orderkey")
    many = lambda t, n: F.repeat(F.lit(t), (k % n).cast("int"))
    log = F.concat(F.lit("Total paragraphs: "), (k % 40).cast("string"), F.lit("\n"), many("Fallback to simple\n", 4), many("JSON parse error\n", 5), many("same as input\n", 7), many("cache hit\n", 3), F.repeat(F.lit("API call\n"), 3))
    out = quality.backend_quality(table(spark, sf_dir, "orders").select(k.alias("run_id"), log.alias("log")))
    return out.select("run_id", *[F.col(c).cast("long") for c in ("paragraphs", "fallbacks", "json_errors", "same", "cache_hits", "calls")], "fallback_ratio", "hit_ratio", "status")


@query("""WITH c AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'real_' ELSE '' END || CASE WHEN value > 50 THEN 'protect' ELSE 'translate' END AS bucket FROM events) SELECT event_id, bucket FROM c QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY event_id) <= 25""")
def selected_cases(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("pos"), F.when(F.col("event_type") == "error", "backend_retry_failures").otherwise("events").alias("origin"), F.when(F.col("value") > 50, "protect").otherwise("translate").alias("expected_behavior"))
    return quality.select_cases(e, 25).select("event_id", "bucket")


@query("""WITH h AS (SELECT CASE event_type WHEN 'error' THEN 'protect' WHEN 'click' THEN 'translate' ELSE event_type END AS kind, count(*) AS n FROM events GROUP BY 1) SELECT k.kind, coalesce(n, 0) AS n FROM (VALUES ('real_translate'), ('translate'), ('protect')) k(kind) LEFT JOIN h USING (kind) WHERE coalesce(n, 0) < 2000""")
def scarce_cases(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "protect").when(F.col("event_type") == "click", "translate").otherwise(F.col("event_type")).alias("kind"))
    return quality.case_warnings(e, 2000)


@query("""SELECT c_custkey AS doc_id, unnest(list_filter([CASE WHEN c_acctbal < 0 THEN 'in debt' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'builder' END], lambda x: x IS NOT NULL)) AS title, CASE WHEN title = 'in debt' THEN 'high' ELSE 'low' END AS severity FROM customer""")
def raised_flags(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "doc_id")
    return rewrites.flag_issues(c, {"a": (F.col("c_acctbal") < 0, "high", "in debt"), "b": (F.col("c_mktsegment") == "BUILDING", "low", "builder")})


@query("""WITH a AS (SELECT event_id, props->>'k' AS k FROM events), b AS (SELECT event_id, list_filter([CASE WHEN k::INT % 2 = 0 THEN 'failed.even' END, 'missing'], lambda x: x IS NOT NULL) AS failed FROM a) SELECT event_id, array_to_string(failed, ',') AS failed, len(failed) = 0 AS passed FROM b""")
def evidence_judged(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"ok": true, "failed": {"even": '), F.when(k % 2 == 0, "false").otherwise("true"), F.lit("}}")).alias("evidence"))
    return rewrites.judge_evidence(e, "evidence", ("ok", "failed.even", "missing")).select("event_id", F.array_join("failed", ",").alias("failed"), "passed")


_RULE_ROWS = (("debt", "warn", ("small",), (), 0, ()), ("colours", "blocking", (), ("red", "widget", "ring"), 2, ("small",)), ("none", "info", ("^large",), ("plate",), 1, ()))


@query(f"""WITH p AS (SELECT p_partkey AS doc_id, 1 AS page, p_name AS t FROM part)
SELECT doc_id, page, 'debt' AS rule, 'warn' AS severity FROM p WHERE contains(t, 'small') UNION ALL SELECT doc_id, page, 'colours', 'blocking' FROM p WHERE contains(t, 'red')::INT + contains(t, 'widget')::INT + contains(t, 'ring')::INT >= 2 AND NOT contains(t, 'small') UNION ALL SELECT doc_id, page, 'none', 'info' FROM p WHERE starts_with(t, 'large') AND contains(t, 'plate')""")
def rules_on_pages(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.col("p_name").alias("text"))
    rules = spark.createDataFrame([(r, s, list(a), list(b), n, list(x)) for r, s, a, b, n, x in _RULE_ROWS], "rule string, severity string, all_of array<string>, any_of array<string>, least int, none_of array<string>")
    return rewrites.page_rules(p, rules)
