"""Queries over the test tables, one or more for each operator family, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as T
from .operators import align, blocks, events, quality, spans, terms
from .registry import ORACLE_SQL, QUERIES, query, table
from .sources import readers

_LINES = r"(SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


@query(r"""
WITH l AS (SELECT DISTINCT doc_id, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
SELECT line, count(*) AS n_docs, row_number() OVER (ORDER BY count(*) DESC, line) AS place
FROM l WHERE length(line) BETWEEN 16 AND 140 AND NOT regexp_full_match(line, '[0-9]+') GROUP BY line HAVING count(*) >= 2 QUALIFY place <= 100""")
def repeated_lines_topk(spark, sf_dir):
    return blocks.frequent_lines(blocks.lines(table(spark, sf_dir, "documents")))


@query(rf"""
WITH l AS (SELECT doc_id, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM {_LINES}),
r AS (SELECT doc_id, CASE WHEN line = '' THEN ''
  WHEN regexp_matches(line, '(?i)^(?:page\s*)?\d+$') THEN 'page_number' WHEN regexp_matches(line, '(?i)^ARTICLE$') THEN 'article_marker' WHEN regexp_matches(line, '(?i)^OPEN$') THEN 'article_open_marker'
  WHEN regexp_matches(line, '(?i)(?:^|[^A-Za-z0-9_])(?:copyright|all rights reserved|published by|license)(?:[^A-Za-z0-9_]|$)') THEN 'copyright'
  WHEN regexp_matches(line, '(?i)^(?:doi|https?://doi\.org|www\.nature\.com|nature\.com)(?:[^A-Za-z0-9_]|$)') THEN 'doi_footer'
  WHEN regexp_matches(line, '(?i)(?:^|[^A-Za-z0-9_])(?:humanities and social sciences communications|nature|springer|elsevier|acm|ieee)(?:[^A-Za-z0-9_].*)?\|\s*(?:\(?\d{{4}}\)?|\d+)') THEN 'journal_footer'
  WHEN regexp_matches(line, '(?i)^arxiv\s*:\s*\d{{4}}\.\d+') THEN 'arxiv_footer'
  WHEN length(line) <= 140 AND regexp_matches(line, '(?i)(?:^|[^A-Za-z0-9_])(?:doi|arxiv|issn|isbn|copyright|received|accepted|published|corresponding author|e-?mail)(?:[^A-Za-z0-9_]|$)') THEN 'metadata_line'
  ELSE '' END AS noise_reason, line FROM l)
SELECT doc_id, noise_reason, count(*) AS n, sum(length(line))::BIGINT AS n_chars FROM r WHERE line <> '' GROUP BY doc_id, noise_reason""")
def line_noise_split(spark, sf_dir):
    rows = blocks.lines(table(spark, sf_dir, "documents")).select("doc_id", T.collapse(F.col("line")).alias("line")).where("line <> ''")
    return rows.withColumn("noise_reason", T.noise_reason(F.col("line"), collapsed=True)).groupBy("doc_id", "noise_reason").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("n_chars"))


@query(r"""SELECT doc_id, length(regexp_replace(regexp_replace(text, 'https?://[^\s<>\])}"'']+', '', 'g'), '[^\p{L}\p{N}]+', '', 'g')) AS n FROM documents""")
def substantive_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.substantive_length(F.col("text")).cast("long").alias("n"))


_ALPHA = r"list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Za-z]+'))"


@query(rf"""
WITH t AS (SELECT doc_id, list_transform({_ALPHA}, lambda x: length(x)) AS n, text FROM documents)
SELECT doc_id, len(n) AS n_tokens, coalesce(list_max(n), 0) AS longest, CASE WHEN len(n) > 0 THEN round(list_sum(n) / len(n), 2) ELSE 0 END AS average,
  len(list_filter(n, lambda x: x >= 18)) AS n_long, len(regexp_extract_all(text, '[A-Za-z]-\n[A-Za-z]')) AS n_breaks FROM t""")
def token_profile(spark, sf_dir):
    out = blocks.extraction_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_tokens").cast("long"), F.col("longest").cast("long"), "average", F.col("n_long").cast("long"), F.col("n_breaks").cast("long"))


@query(r"""
WITH w AS (SELECT doc_id, generate_subscripts(l, 1) AS at, unnest(l) AS term FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][A-Z0-9]+s?')) AS l FROM documents))
SELECT term, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, term) AS place FROM w GROUP BY term QUALIFY place <= 40""")
def term_candidates(spark, sf_dir):
    found = terms.occurrences(table(spark, sf_dir, "documents")).where("kind = 'acronym'")
    top = found.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(40)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "term")).cast("long"))


@query(r"""SELECT doc_id, generate_subscripts(m, 1) - 1 AS nth, unnest(m) AS value FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS m FROM documents)""")
def protected_email_spans(spark, sf_dir):
    out = spans.single_kind(table(spark, sf_dir, "documents"), r"[A-Za-z0-9_.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
    return out.select("doc_id", F.col("nth").cast("long"), "value")


@query(r"""SELECT doc_id, generate_subscripts(m, 1) - 1 AS nth, unnest(m) AS value FROM (SELECT doc_id, regexp_extract_all(text, '\$[^$\n]{1,240}\$') AS m FROM documents)""")
def inline_math(spark, sf_dir):
    return spans.single_kind(table(spark, sf_dir, "documents"), r"\$[^$\n]{1,240}\$").select("doc_id", F.col("nth").cast("long"), "value")


@query(rf"""
WITH l AS (SELECT *, trim(line) = '' AS blank, regexp_matches(trim(line), '(?i)^(?:abstract|introduction|related work|methodology|methods|experiments|results|discussion|conclusion|references)(?:[^\p{{L}}\p{{N}}_]|$)') OR regexp_matches(trim(line), '^#{{1,6}}\s+\S+') AS head FROM {_LINES}),
s AS (SELECT *, NOT blank AND (head OR pos = 0 OR coalesce(lag(blank) OVER w, true) OR coalesce(lag(head) OVER w, true)) AS start FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
i AS (SELECT *, sum(start::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM s)
SELECT doc_id, island::BIGINT AS pos, length(trim(string_agg(rtrim(line), chr(10) ORDER BY pos))) AS char_count, bool_or(head) AS is_heading FROM i WHERE NOT blank GROUP BY doc_id, island""")
def block_build(spark, sf_dir):
    out = blocks.build_blocks(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("pos").cast("long"), F.col("char_count").cast("long"), (F.col("element_type") == "heading").alias("is_heading"))


_BREAK = "p|br|div|section|article|h1|h2|h3|li|tr"


@query(rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>', ' ', 'g'), '(?s)<!--.*?-->|<!\[?[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '(?i)<(?:{_BREAK})(?:\s[^>]*)?/?>|</(?:p|div|section|article|h1|h2|h3|li|tr)\s*>', chr(10), 'g') AS h FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(h, '</?[A-Za-z][^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS h FROM a)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(h, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b""")
def html_visible_text(spark, sf_dir):
    return readers.html_text(table(spark, sf_dir, "pages"))


_URL = r"""SELECT page_id, s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM (
  SELECT page_id, lower(regexp_extract(url, '^(?i)(https?)://', 1)) AS s, lower(regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), ':\d*$', '')) AS h,
    regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS p,
    list_sort(list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_')), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)) AS q
  FROM pages) WHERE h <> ''"""


@query(_URL)
def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical")).where("canonical is not null")


@query(f"""WITH c AS ({_URL}) SELECT canonical, min(page_id) AS first_page, count(*) AS n FROM c GROUP BY canonical HAVING count(*) > 1""")
def canonical_url_dups(spark, sf_dir):
    return canonical_urls(spark, sf_dir).groupBy("canonical").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).where("n > 1")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''")
def claim_containment(spark, sf_dir):
    needles = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    return align.containment(table(spark, sf_dir, "documents").select("doc_id", "text"), needles, "doc_id", "text", "item_id", "needle")


@query("""SELECT 'order_without_line' AS code, o_orderkey AS key FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'line_without_order', l_orderkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'order_without_customer', o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'customer_without_nation', c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey)""")
def fk_orphans(spark, sf_dir):
    o, li, c, n = (table(spark, sf_dir, x) for x in ("orders", "lineitem", "customer", "nation"))
    parts = (
        (align.orphans(o.select("o_orderkey"), li.select("l_orderkey").distinct(), "o_orderkey", "l_orderkey"), "o_orderkey", "order_without_line"),
        (align.orphans(li.select("l_orderkey"), o, "l_orderkey", "o_orderkey"), "l_orderkey", "line_without_order"),
        (align.orphans(o.select("o_orderkey", "o_custkey"), c, "o_custkey", "c_custkey"), "o_orderkey", "order_without_customer"),
        (align.orphans(c.select("c_custkey", "c_nationkey"), n, "c_nationkey", "n_nationkey"), "c_custkey", "customer_without_nation"),
    )
    rows = [df.select(F.lit(code).alias("code"), F.col(k).cast("long").alias("key")) for df, k, code in parts]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return align.duplicated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH r AS (SELECT *, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20)::BIGINT AS win FROM events)
SELECT user_id, win AS "window", count(*) AS n, sum((event_type <> 'error')::INT)::BIGINT AS ok, sum((event_type = 'error')::INT)::BIGINT AS missing, round(sum((event_type <> 'error')::INT) / count(*), 3) AS ratio,
  sum((event_type = 'error')::INT) > greatest(2, floor(count(*) * 0.03)) AS blocking FROM r GROUP BY user_id, win""")
def tumbling_row_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return blocks.tumbling_windows(e, "user_id", ["ts", "event_id"], F.col("event_type") != "error", F.col("event_type") == "error")


@query(r"""WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN next_role IS DISTINCT FROM 'assistant' THEN 'missing' WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = trim(regexp_replace(answer, '\s+', ' ', 'g')) THEN 'same' ELSE 'ok' END AS status FROM t WHERE role = 'user'""")
def turn_alignment(spark, sf_dir):
    c = blocks.neighbours(table(spark, sf_dir, "conversations").withColumn("t", F.struct("role", "text")), "conv_id", "turn", "t")
    status = F.when(~F.coalesce(F.col("next.role") == "assistant", F.lit(False)), "missing").when(T.collapse(F.col("text")) == T.collapse(F.col("next.text")), "same").otherwise("ok")
    return c.where("role = 'user'").select("conv_id", "turn", status.alias("status"))


_TOKENS = r"list_filter(list_distinct(regexp_extract_all(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), '[a-z0-9]+')), lambda x: length(x) > 1 AND x NOT IN ('the','and','for','with','from','this','that','into','are','was','were'))"


@query(rf"""WITH a AS (SELECT conv_id * 1000 + turn AS turn_id, {_TOKENS} AS t FROM conversations), b AS (SELECT item_id, {_TOKENS} AS t FROM benchmark),
x AS (SELECT turn_id, len(t) AS na, unnest(t) AS k FROM a), y AS (SELECT item_id, len(t) AS nb, unnest(t) AS k FROM b),
p AS (SELECT turn_id, item_id, round(count(*) / (any_value(na) + any_value(nb) - count(*)), 4) AS score FROM x JOIN y USING (k) GROUP BY ALL)
SELECT turn_id, item_id, score FROM p WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY score DESC, item_id) = 1""")
def best_match_argmax(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    return align.best_by_tokens(a, table(spark, sf_dir, "benchmark"), "turn_id", "item_id", 0.05)


@query()
def fuzzy_match_difflib(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n_lines = docs.select(F.sum(F.size(F.split("text", "\n"))).alias("n")).first()["n"]
    rows = blocks.lines(docs).select(T.collapse(F.col("line")).alias("text")).where("text <> ''").distinct()
    rows = rows.select(F.xxhash64("text").alias("line_id"), "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", T.collapse(F.col("text")).alias("text"))
    return align.best_fuzzy(rows, items, "line_id", "item_id", [], about=n_lines or 0)


@query("""SELECT lang, count(*) AS n, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low,
  CASE WHEN count(*) FILTER (WHERE severity = 'high') > 0 THEN 'fail' WHEN count(*) FILTER (WHERE severity = 'medium') > 0 THEN 'warn' ELSE 'pass' END AS status
FROM (SELECT lang, CASE WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'medium' ELSE 'low' END AS severity FROM documents JOIN labels USING (doc_id)) GROUP BY lang""")
def label_review_rollup(spark, sf_dir):
    met = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return quality.issue_rollup(met.withColumn("severity", F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "medium").otherwise("low")), ["lang"])


@query("""SELECT event_type, count(*) AS total, count(*) FILTER (WHERE user_id % 2 = 0) AS translate_total, count(*) FILTER (WHERE user_id % 2 <> 0) AS protect_total,
  count(*) FILTER (WHERE value < 5) AS same_as_input, count(*) FILTER (WHERE value > 90) AS placeholder_break,
  round(count(*) FILTER (WHERE value < 5) / greatest(1, count(*) FILTER (WHERE user_id % 2 = 0)), 4) AS same_as_input_rate, round(count(*) FILTER (WHERE value > 90) / greatest(1, count(*)), 4) AS placeholder_break_rate FROM events GROUP BY event_type""")
def probe_group_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 2 == 0, "translate").otherwise("protect").alias("expected_behavior"), (F.col("value") < 5).alias("same_as_input"), (F.col("value") > 90).alias("placeholder_break"))
    return quality.probe_summary(e, ["event_type"], ("same_as_input", "placeholder_break"))


@query("""WITH r AS (SELECT *, CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS k FROM events)
SELECT user_id, event_id, event_type, array_to_string(types, ',') AS types FROM (SELECT user_id, event_id, event_type, list_sort(list(DISTINCT event_type) OVER (PARTITION BY user_id)) AS types, row_number() OVER (PARTITION BY user_id ORDER BY k DESC, event_id) AS n FROM r) WHERE n = 1""")
def keep_worst_dedupe(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_type") == "error", "blocking").when(F.col("event_type") == "purchase", "warn").otherwise("ok").alias("severity"))
    out = quality.keep_worst(e, ["user_id"], "severity", ["event_id"], "event_type")
    return out.select("user_id", "event_id", "event_type", F.array_join("all_types", ",").alias("types"))


@query("""WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), i AS (SELECT *, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS k FROM d),
g AS (SELECT user_id, k, count(*) AS streak, max(day) AS last_day FROM i GROUP BY user_id, k) SELECT user_id, arg_max(streak, last_day) AS streak, max(last_day) AS last_day FROM g GROUP BY user_id""")
def user_streaks(spark, sf_dir):
    return events.streaks(table(spark, sf_dir, "events"), "user_id", "ts")


@query("""SELECT o_orderpriority, count(*) AS due, count(*) FILTER (WHERE o_orderdate::DATE < DATE '1995-06-17') AS overdue FROM orders WHERE o_orderdate::DATE <= DATE '1995-06-17' AND o_orderstatus <> 'F' GROUP BY o_orderpriority""")
def due_today(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("completed", F.col("o_orderstatus") == "F")
    return events.due(o, "o_orderdate", "1995-06-17", ["o_orderpriority"])


@query("""WITH g AS (SELECT c_custkey, 'balance' AS name, CASE WHEN c_acctbal < -500 THEN 'blocking' WHEN c_acctbal < 0 THEN 'warn' ELSE 'ok' END AS status FROM customer
UNION ALL SELECT c_custkey, 'orders', CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'ok' ELSE 'warn' END FROM customer)
SELECT c_custkey, count(*) AS n_gates, count(*) FILTER (WHERE status = 'blocking') AS n_blocking, count(*) FILTER (WHERE status = 'warn') AS n_warn,
  CASE WHEN bool_or(status = 'blocking') THEN 'blocking' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'ok' END AS worst, CASE WHEN bool_or(status = 'blocking') THEN 'partial' ELSE 'delivered' END AS delivery FROM g GROUP BY c_custkey""")
def gate_rollup(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    own = c.select("c_custkey", F.lit("balance").alias("name"), F.when(F.col("c_acctbal") < -500, "blocking").when(F.col("c_acctbal") < 0, "warn").otherwise("ok").alias("status"))
    has = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("_k")).distinct()
    orders = c.select("c_custkey").join(has, F.col("c_custkey") == F.col("_k"), "left").select("c_custkey", F.lit("orders").alias("name"), F.when(F.col("_k").isNull(), "warn").otherwise("ok").alias("status"))
    return quality.gate_rollup(own.unionByName(orders), ["c_custkey"])


@query("""WITH o AS (SELECT p_partkey, 'Brand#' || p_size AS p_brand, '' AS p_type FROM part WHERE p_size > 45) SELECT p.p_partkey, coalesce(o.p_brand, p.p_brand) AS p_brand, p.p_type, CASE WHEN o.p_partkey IS NULL THEN 'default' ELSE 'default+manual' END AS policy_source FROM part p LEFT JOIN o USING (p_partkey)""")
def policy_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    manual = p.where("p_size > 45").select("p_partkey", F.concat(F.lit("Brand#"), "p_size").alias("p_brand"), F.lit("").alias("p_type"))
    return terms.merge_layers([p, manual], "p_partkey", ["p_brand", "p_type"], ["default", "manual"])


@query("""(SELECT o_orderkey AS key, 'declared_only' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))
UNION ALL (SELECT DISTINCT l_orderkey, 'derived_only' FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders))""")
def set_reconcile(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")).distinct()
    b = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key")).distinct()
    return align.reconcile(a, b)


@query("""SELECT r_name, n_name, segment FROM region JOIN nation ON n_regionkey = r_regionkey OR r_regionkey = 0 CROSS JOIN (SELECT DISTINCT c_mktsegment AS segment FROM customer) ORDER BY r_name, n_name, segment LIMIT 60""")
def matrix_cap(spark, sf_dir):
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    s = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    out = align.task_matrix({"region": r, "nation": n, "segment": s}, F.expr("n_regionkey = r_regionkey or r_regionkey = 0"), ["r_name", "n_name", "segment"], 60)
    return out.select("r_name", "n_name", "segment")


_KEYWORDS = (("law", "license", False), ("law", "copyright", True), ("link", "with", False), ("link", "that", False), ("noise", "###", True), ("noise", "!!", False))


@query("""WITH k(topic, word, points) AS (VALUES ('law','license',2),('law','copyright',8),('link','with',2),('link','that',2),('noise','###',8),('noise','!!',2))
SELECT doc_id, topic, sum(points)::BIGINT AS score FROM documents JOIN k ON contains(lower(text), word) GROUP BY doc_id, topic""")
def keyword_score(spark, sf_dir):
    words = spark.createDataFrame(list(_KEYWORDS), "topic string, word string, is_anchor boolean")
    return align.keyword_scores(table(spark, sf_dir, "documents"), words)


@query(r"""SELECT conv_id, turn, len(regexp_extract_all(text, '[A-Za-z]')) >= 18 AND (regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9_])(?:the|this|that|these|those|we|our|agent|agents|method|methods|model|models|task|tasks|learn|learning|memory|performance|trajectory|trajectories)(?:[^A-Za-z0-9_]|$)') OR regexp_matches(text, '[A-Za-z]{4,}(?:[\s,;:()\\/-]+[A-Za-z]{4,}){3,}')) AS ordinary_english,
  regexp_matches(text, '[\x{4e00}-\x{9fff}]') AS has_cjk, regexp_matches(text, '(?i)Translate ordinary English prose') AS prompt_leak FROM conversations""")
def quality_flags(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.ordinary_english(F.col("text")).alias("ordinary_english"), T.has_cjk(F.col("text")).alias("has_cjk"), T.prompt_leak(F.col("text")).alias("prompt_leak"))


_INTENTS = "CASE WHEN event_type = 'error' THEN 'revise' WHEN event_type = 'purchase' THEN 'confirm' WHEN event_type = 'signup' THEN 'propose' WHEN event_type = 'click' THEN 'build' ELSE 'clarify' END"


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.struct("ts", "event_id").alias("pos"), F.expr(_INTENTS).alias("intent"))


@query(f"""WITH RECURSIVE t(state, intent, next, status) AS (VALUES {", ".join(str(x) for x in events.TRANSITIONS)}), e AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, {_INTENTS} AS intent FROM events),
r AS (SELECT DISTINCT run_id, 0::BIGINT AS n, 'intake' AS state, 'active' AS status, 0::BIGINT AS moves, 0::BIGINT AS refused FROM e UNION ALL SELECT e.run_id, e.n, coalesce(t.next, r.state), coalesce(t.status, r.status), r.moves + (t.next IS NOT NULL)::BIGINT, r.refused + (t.next IS NULL)::BIGINT FROM r JOIN e ON e.run_id = r.run_id AND e.n = r.n + 1 LEFT JOIN t ON t.state = r.state AND t.intent = e.intent)
SELECT run_id, state, status, moves, refused FROM r QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC) = 1""")
def state_machine(spark, sf_dir):
    return events.run_states_native(_runs(spark, sf_dir))


@query(r"""SELECT doc_id, CASE WHEN length(t) <= 180 THEN t ELSE substr(t, 1, 179) || '…' END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query(r"""SELECT page_id, trim(regexp_replace(lower(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), '[^a-z0-9\x{4e00}-\x{9fff}]+', ' ', 'g')) AS canonical FROM pages""")
def canonical_page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.canonical(F.col("html")).alias("canonical"))


@query("""SELECT n_regionkey, count(*) AS total, count(*) FILTER (WHERE s_acctbal > 0) AS completed, count(*) FILTER (WHERE s_acctbal <= 0) AS active, round(100 * count(*) FILTER (WHERE s_acctbal > 0) / greatest(1, count(*)))::BIGINT AS percentage FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_regionkey""")
def dashboard_facts(spark, sf_dir):
    met = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("completed", F.col("s_acctbal") > 0)
    return quality.dashboard(met, ["n_regionkey"])


@query("""SELECT o_orderkey, round(o_totalprice + c_acctbal, 2) AS sum, CASE WHEN o_totalprice = 0 THEN 0 ELSE round((o_totalprice - c_acctbal) / o_totalprice * 100, 2) END AS profit_margin FROM orders JOIN customer ON c_custkey = o_custkey""")
def calculators(spark, sf_dir):
    met = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    c = T.calculators(F.col("o_totalprice"), F.col("c_acctbal"))
    return met.select("o_orderkey", c["sum"].alias("sum"), c["profit_margin"].alias("profit_margin"))


@query("""SELECT o_orderkey, date_trunc('week', o_orderdate)::DATE AS week FROM orders""")
def week_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.week_start(F.col("o_orderdate")).alias("week"))


@query("""WITH t AS (SELECT *, last_value(CASE WHEN event_type = 'error' THEN true WHEN event_type = 'purchase' THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events)
SELECT user_id, count(*) FILTER (WHERE coalesce(m, false)) AS in_mode, count(*) AS n FROM t GROUP BY user_id""")
def running_mode(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    out = blocks.running_mode(e, "user_id", "at", F.col("event_type") == "error", F.col("event_type") == "purchase")
    return out.groupBy("user_id").agg(F.count_if("mode").alias("in_mode"), F.count("*").alias("n"))


from . import block_queries, box_queries, quality_queries, record_queries, rule_queries, text_queries  # noqa: E402, F401  (they register their queries)
