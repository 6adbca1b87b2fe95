"""Queries of the operators on sources, events, research records and routes, over orders, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import align, events, research, rewrites, routing
from .registry import picked, picked_sql, query, quoted, table
from .sources import readers
from .streaming import ledgers
from .text_queries import collapsed, has

# --- sources ----------------------------------------------------------------------------------------

_SUFFIXES, _FAILURES = ("txt", "md", "MARKDOWN", "tex", "htm", "HTML", "pdf", "docx", "pdf", "x.pdf"), ("protected_pdf", None)


@query(f"""WITH p AS (SELECT page_id, lower({picked_sql("page_id", _SUFFIXES)}) AS suffix, CASE page_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN 'short' ELSE html END AS t, CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id % 40 END AS pages, {picked_sql("page_id", _FAILURES)} AS failure FROM pages),
k AS (SELECT *, CASE WHEN suffix IN ('txt', 'md', 'markdown') THEN 'text' WHEN suffix = 'tex' THEN 'latex' WHEN suffix IN ('htm', 'html') THEN 'html' WHEN suffix LIKE '%pdf' THEN 'pdf' ELSE 'unsupported_layout' END AS kind, length(trim(t)) AS n FROM p)
SELECT page_id, kind, CASE WHEN kind = 'pdf' AND n = 0 THEN coalesce(failure, 'needs_ocr') WHEN kind = 'pdf' AND (n < 500 OR n / greatest(1, coalesce(pages, 1)) < 200) THEN 'needs_ocr_review' WHEN n = 0 THEN 'empty_source' ELSE 'ready' END AS status FROM k""")
def source_kinds(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("dir/f."), picked("page_id", _SUFFIXES)).alias("path"), F.when(F.col("page_id") % 5 == 0, "  ").when(F.col("page_id") % 5 == 1, "short").otherwise(F.col("html")).alias("t"), F.when(F.col("page_id") % 3 != 0, F.col("page_id") % 40).alias("pages"), picked("page_id", _FAILURES).alias("failure"))
    kind = readers.input_type(F.col("path"))
    return p.select("page_id", kind.alias("kind"), readers.source_status(kind, F.col("t"), F.col("pages"), F.col("failure")).alias("status"))


_ERRORS = ("", "Password required", "file is corrupt", "not installed", "timed out", None, "no module named x", "")


@query(f"""WITH a AS (SELECT event_id // 2 AS doc_id, CASE WHEN event_type = 'view' THEN 'ok' ELSE 'failed' END AS status, lower(coalesce({picked_sql("event_id * 3", _ERRORS)}, '')) AS e FROM events),
g AS (SELECT doc_id, bool_or({has("e", "password|encrypt|protected")}) AS p, bool_or({has("e", "corrupt|damaged|broken|syntax")}) AS c, bool_or(e <> '' AND NOT {has("e", "not installed|no module|dependency")}) AS r, bool_or(status = 'ok') AS ok FROM a GROUP BY doc_id)
SELECT doc_id, CASE WHEN p THEN 'protected_pdf' WHEN c THEN 'corrupt_pdf' WHEN r AND NOT ok THEN 'read_error' WHEN NOT ok THEN 'needs_pdf_dependency' ELSE 'needs_ocr' END AS failure FROM g""")
def pdf_failures(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.col("event_id") * 3)
    return readers.pdf_failure(e.select(F.expr("event_id div 2").alias("doc_id"), F.when(F.col("event_type") == "view", "ok").otherwise("failed").alias("status"), picked("k", _ERRORS).alias("error")))


@query("""SELECT c_custkey AS doc_id, 1 AS page, 0 AS line_index, c_name || CASE WHEN c_custkey % 3 = 0 THEN ' R & D' ELSE ' ' || c_mktsegment END AS text, (c_custkey % 500)::DOUBLE AS x0, (c_custkey % 700)::DOUBLE / 2 AS y1, 600.0::DOUBLE AS page_width, 2 AS n_words FROM customer
UNION ALL SELECT c_custkey, 2, 0, 'second', 1, 4, 600, 1 FROM customer WHERE c_custkey % 2 = 0""")
def positioned_lines(spark, sf_dir):
    k = F.col("c_custkey")
    word = lambda t: F.concat(F.lit('<word xMin="1" yMin="2" xMax="3" yMax="4">'), t, F.lit("</word>"))
    line = F.concat(F.lit('<line xMin="'), (k % 500).cast("string"), F.lit('" yMin="0" xMax="9" yMax="'), ((k % 700) / 2).cast("string"), F.lit('">'), word(F.col("c_name")), word(F.when(k % 3 == 0, "R & D").otherwise(F.col("c_mktsegment"))), F.lit("</line>"))
    more = F.when(k % 2 == 0, F.concat(F.lit('<page width="600" height="800"><line xMin="1" yMin="2" xMax="3" yMax="4">'), word(F.lit("second")), F.lit("</line></page>"))).otherwise("")
    x = F.concat(F.lit('<doc><page width="600" height="800"><flow><block>'), line, F.lit("</block></flow></page>"), more, F.lit("</doc>"))
    out = readers.bbox_lines(table(spark, sf_dir, "customer").select(k.alias("doc_id"), x.alias("xhtml")))
    return out.select("doc_id", "page", "line_index", "text", F.col("bbox.x0").alias("x0"), F.col("bbox.y1").alias("y1"), "page_width", F.size("words").alias("n_words"))


_TRACKED = """(SELECT o_orderkey AS doc_id, 'page' AS tracking_group, 0 AS i, 0 AS pos, (o_orderkey % 7 + 1)::INT AS page, 'a' || o_orderkey::VARCHAR AS debug_id, o_orderpriority AS input, o_orderkey % 3 = 0 AS fallback FROM orders UNION ALL SELECT o_orderkey, 'page', 0, 1, (o_orderkey % 7 + 1)::INT, 'b' || o_orderkey::VARCHAR, 'x', false FROM orders
UNION ALL SELECT o_orderkey, 'page', 1, 0, 2, 'c' || o_orderkey::VARCHAR, 'y', false FROM orders UNION ALL SELECT o_orderkey, 'cross_page', 0, 0, NULL, 'd' || o_orderkey::VARCHAR, 'z', true FROM orders WHERE o_orderkey % 2 = 0)"""


def _tracked(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    head = F.concat(F.lit('{"page": [{"page": '), (F.col("o_orderkey") % 7 + 1).cast("string"), F.lit(', "paragraph": [{"debug_id": "a'), k, F.lit('", "input": "'), F.col("o_orderpriority"), F.lit('", "llm_translate_trackers": [{"fallback_to_translate": false}, {"fallback_to_translate": '), (F.col("o_orderkey") % 3 == 0).cast("string"), F.lit('}]}, {"debug_id": "b'), k, F.lit('", "input": "x"}]}, {"paragraph": [{"debug_id": "c'), k, F.lit('", "input": "y"}]}]'))
    cross = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(', "cross_page": [{"paragraph": [{"debug_id": "d'), k, F.lit('", "input": "z", "llm_translate_trackers": [{"fallback_to_translate": true}]}]}]}'))).otherwise(', "cross_column": []}')
    return readers.tracking_paragraphs(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(head, cross).alias("payload")))


@query(f"SELECT * FROM {_TRACKED}")
def tracked_paragraphs(spark, sf_dir):
    return _tracked(spark, sf_dir).select("doc_id", "tracking_group", "i", "pos", "page", "debug_id", "input", "fallback")


@query(f"SELECT doc_id, page, debug_id FROM {_TRACKED} WHERE fallback")
def fallback_paragraphs(spark, sf_dir):
    return _tracked(spark, sf_dir).where("fallback").select("doc_id", "page", "debug_id")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN (props->>'k')::BIGINT END AS k, CASE WHEN event_id % 4 IN (1, 2) THEN 'invalid_json' END AS error FROM events""")
def guarded_payloads(spark, sf_dir):
    k = F.col("event_id") % 4
    e = table(spark, sf_dir, "events").select("event_id", F.when(k == 0, F.col("props")).when(k == 1, "not json").when(k == 2, '{"k": ').alias("payload"))
    return readers.guarded_json(e, "payload", "k bigint", "error").select("event_id", "parsed.k", "error")


@query("""WITH a AS (SELECT DISTINCT 'orders' AS origin, o_orderpriority AS source FROM orders UNION SELECT DISTINCT 'parts', p_name FROM part WHERE p_name <> '') SELECT origin, source, 'case-' || substr(sha1(origin || '|' || source), 1, 12) AS id FROM a""")
def loaded_cases(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("input"), F.lit("title").alias("layout_role"))
    p = table(spark, sf_dir, "part").select(F.lit("").alias("source"), F.col("p_name").alias("visible_text"), F.lit("x").alias("failure_type"))
    return readers.load_cases({"orders": o, "parts": p}).select("origin", "source", "id")


@query("""SELECT c_mktsegment AS module, 'expense' AS entry_type, c_custkey::VARCHAR AS amount, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE '' END AS category, '' AS date, '' AS notes, (c_acctbal > 0)::VARCHAR AS completed FROM customer""")
def ledger_rows(spark, sf_dir):
    values = F.map_filter(F.create_map(F.lit("entry_type"), F.lit("expense"), F.lit("amount"), F.col("c_custkey").cast("string"), F.lit("category"), F.when(F.col("c_custkey") % 2 == 0, "even")), lambda _, v: v.isNotNull())
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("module"), values.alias("values"), (F.col("c_acctbal") > 0).alias("completed"), F.lit("").alias("updated_at"))
    return readers.ledger_csv(c).drop("updated_at")


@query("""WITH t AS (SELECT l_orderkey AS id, max(l_partkey) AS p FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS source, 't' || p::VARCHAR AS translation, CASE WHEN p % 2 = 0 THEN 'done' ELSE o_orderstatus END AS status FROM orders LEFT JOIN t ON t.id = o_orderkey""")
def translated_segments(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    s = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, k).alias("id"), F.when(F.col("o_orderkey") % 2 == 1, k).alias("segment_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("status"))
    t = table(spark, sf_dir, "lineitem").select(F.lit(None).cast("string").alias("id"), F.col("l_orderkey").cast("string").alias("segment_id"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("translation"), F.when(F.col("l_partkey") % 2 == 0, "done").otherwise("").alias("status"), F.col("l_partkey").alias("line_no"))
    return readers.segments_with_translations(s, t)


@query("""SELECT o_custkey AS doc_id, o_orderkey AS pos, 'layout' AS origin FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 3 = 0 UNION ALL SELECT o_custkey, o_orderkey, 'adapter' FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 3 = 0)""")
def layout_sources(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"))
    return readers.layout_or_adapter(o.where("doc_id % 2 = 0 and pos % 3 = 0").withColumn("origin", F.lit("layout")), o.withColumn("origin", F.lit("adapter")))


_NAMES = ("mono", "dual", "bilingual", "plain")


@query(f"""WITH f AS (SELECT 'out/' || CASE WHEN page_id % 5 = 0 THEN 'cache/' ELSE '' END || {picked_sql("page_id", _NAMES)} || page_id::VARCHAR || '.pdf' AS path FROM pages), k AS (SELECT * FROM f WHERE NOT contains(path, '/cache/'))
SELECT coalesce(min(path) FILTER (WHERE contains(path, 'dual') OR contains(path, 'bilingual')), min(path)) AS dual, coalesce(min(path) FILTER (WHERE contains(path, 'mono')), min(path)) AS mono FROM k""")
def picked_outputs(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return readers.pick_outputs(p.select(F.concat(F.lit("out/"), F.when(F.col("page_id") % 5 == 0, "cache/").otherwise(""), picked("page_id", _NAMES), F.col("page_id").cast("string"), F.lit(".pdf")).alias("path")))


_TEX, _BODIES = ("src/main.tex", "supp/extra.tex", "paper.tex", "fig.tex", "template/main.tex", "a.tex"), ("\\documentclass{a}\\title{x}\\begin{document}\\section{y}", "\\section{z}", "", "\\begin{document}", "x" * 12000)


@query(f"""WITH f AS (SELECT o_custkey AS doc_id, {picked_sql("o_orderkey", _TEX)} AS path, {picked_sql("o_orderkey", _BODIES)} AS c FROM orders), s AS (SELECT doc_id, path, CASE WHEN {has("path", r"(?:^|/)(?:main|paper|article|ms)\.tex$")} THEN 80 ELSE 0 END - CASE WHEN {has("path", "supp|appendix|response|cover|template")} THEN 120 ELSE 0 END + CASE WHEN contains(c, '\\begin{{document}}') THEN 200 ELSE 0 END
 + CASE WHEN contains(c, '\\title') THEN 50 ELSE 0 END + CASE WHEN contains(c, '\\section') THEN 30 ELSE 0 END + CASE WHEN contains(c, '\\documentclass') THEN 50 ELSE 0 END + least(length(c) // 5000, 20) AS score FROM f)
SELECT doc_id, path, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, path) = 1""")
def main_files(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), picked("o_orderkey", _TEX).alias("path"), picked("o_orderkey", _BODIES).alias("content"))
    return readers.main_latex_file(o).select("doc_id", "path", F.col("score").cast("long"))


# --- events -----------------------------------------------------------------------------------------

_RAW = ("hello", "  ", "a longer answer ", None, "x")


@query(f"""WITH e AS (SELECT user_id AS run_id, event_id // 2 * 2 AS event_id, event_id AS pos, event_id % 13 AS turn_index, {picked_sql("event_id", _RAW)} AS raw_text FROM events),
s AS (SELECT *, max(turn_index) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, CASE pos % 3 WHEN 0 THEN sha256('hello') WHEN 1 THEN sha256(trim(coalesce(raw_text, ''))) END AS h FROM e)
SELECT run_id, event_id, 'event_id_duplicate' AS code FROM e GROUP BY run_id, event_id HAVING count(*) > 1 UNION ALL SELECT run_id, event_id, 'turn_index_not_increasing' FROM s WHERE turn_index <= before UNION ALL SELECT run_id, event_id, 'raw_text_empty' FROM e WHERE trim(coalesce(raw_text, '')) = ''
UNION ALL SELECT run_id, event_id, 'raw_text_hash_mismatch' FROM s WHERE h IS NOT NULL AND sha256(trim(coalesce(raw_text, ''))) <> h""")
def event_order_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.expr("event_id div 2 * 2").alias("event_id"), F.col("event_id").alias("pos"), (F.col("event_id") % 13).alias("turn_index"), picked("event_id", _RAW).alias("raw_text"))
    given = F.when(F.col("pos") % 3 == 0, F.sha2(F.lit("hello"), 256)).when(F.col("pos") % 3 == 1, F.sha2(F.trim(F.coalesce("raw_text", F.lit(""))), 256))
    return events.order_errors(e.withColumn("raw_text_sha256", given))


@query("""WITH a AS (SELECT user_id AS row_id, event_id % 6 + 1 AS attempt FROM events) SELECT row_id, count(*) AS attempts, (row_id * 10 + max(attempt))::VARCHAR AS output, CASE WHEN max(attempt) > 1 THEN least(4.0::DOUBLE, 0.5::DOUBLE * pow(2, max(attempt) - 2)) ELSE 0 END AS delay FROM a GROUP BY row_id""")
def retried_rows(spark, sf_dir):
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("row_id"), (F.col("event_id") % 6 + 1).alias("attempt"))
    return events.retry_outcome(a.withColumn("output", (F.col("row_id") * 10 + F.col("attempt")).cast("string")))


@query("""SELECT c_custkey AS run_id FROM customer WHERE NOT (c_custkey % 4 IS NOT DISTINCT FROM CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 4 END) OR c_custkey % 5 = 0""")
def unbound_candidates(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("run_id"), (k % 4).cast("string").alias("presented_sha256"), F.when(k % 5 == 0, "moved").otherwise((k % 4).cast("string")).alias("current_sha256"))
    locks = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(k.alias("run_id"), (k % 4).cast("string").alias("locked_sha256"))
    return events.binding_errors(c, locks)


_STATES = ("ready_to_build", "intake", "candidate_built", "local_delivered", "clarifying")


@query(f"""SELECT c_custkey + 1000000 AS run_id, 'ready_to_build' AS state, 'active' AS status, c_custkey AS superseded_from FROM customer WHERE {picked_sql("c_custkey", _STATES)} IN ('ready_to_build', 'candidate_built', 'local_delivered')""")
def cloned_runs(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), picked("c_custkey", _STATES).alias("state"), F.lit("old").alias("status"))
    return events.clone_confirmed(c, F.col("run_id") + 1000000)


_AMOUNTS, _DAYS, _FLAGS = ("12.5", "abc", None, "7", "-3"), ("2024-02-29", "2023-02-30", None, "2024-01-05"), ("true", "maybe", None, "false")


def _records(spark, sf_dir):
    v = F.map_filter(F.create_map(F.lit("amount"), picked("o_orderkey", _AMOUNTS), F.lit("day"), picked("o_orderkey", _DAYS), F.lit("done"), picked("o_custkey", _FLAGS), F.lit("extra"), F.when(F.col("o_orderkey") % 50 == 0, "x")), lambda _, x: x.isNotNull())
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), v.alias("values"))


_FIELDS = {"amount": "number", "day": "date", "done": "boolean"}
_GOOD = f"(SELECT o_orderkey AS id, o_orderkey % 50 = 0 OR coalesce({picked_sql('o_orderkey', _AMOUNTS)} = 'abc', false) OR coalesce({picked_sql('o_orderkey', _DAYS)} = '2023-02-30', false) OR coalesce({picked_sql('o_custkey', _FLAGS)} = 'maybe', false) AS bad, {picked_sql('o_orderkey', _AMOUNTS)} AS amount, {picked_sql('o_orderkey', _DAYS)} AS day, {picked_sql('o_custkey', _FLAGS)} AS done FROM orders)"


@query(f"SELECT id, amount::DOUBLE AS amount, day::DATE AS day, done::BOOLEAN AS done FROM {_GOOD} WHERE NOT bad")
def imported_records(spark, sf_dir):
    return events.import_records(_records(spark, sf_dir), _FIELDS)[0]


@query(f"SELECT id FROM {_GOOD} WHERE bad")
def quarantined_records(spark, sf_dir):
    return events.import_records(_records(spark, sf_dir), _FIELDS)[1].select("id")


@query(f"SELECT id FROM {_GOOD} WHERE contains(lower(concat_ws(' ', amount, day, done, CASE WHEN id % 50 = 0 THEN 'x' END)), 'abc')")
def matching_records(spark, sf_dir):
    return events.filter_records(_records(spark, sf_dir), "ABC").select("id")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def counted_windows(spark, sf_dir):
    return ledgers.keyed_counts(table(spark, sf_dir, "events"), ["event_type"])


# --- aligned rows -----------------------------------------------------------------------------------


@query("""WITH r AS (SELECT l_orderkey, max(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, o_orderstatus, l_partkey FROM orders LEFT JOIN r ON l_orderkey = o_orderkey""")
def last_lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return align.join_last(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), li, "o_orderkey", "l_partkey")


@query("""SELECT id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM (SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier UNION ALL SELECT p_partkey, 'part' FROM part) GROUP BY id HAVING count(DISTINCT kind) > 1""")
def shared_keys(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    out = align.shared_ids({"customer": (t("customer"), "c_custkey"), "supplier": (t("supplier"), "s_suppkey"), "part": (t("part"), "p_partkey")})
    return out.select("id", F.array_join("kinds", ",").alias("kinds"))


_SEEN = ("The model keeps its memory across tasks", "Completely different words", "model keeps its memory", "short", "AB-12 [x]", "several shared tokens between both of these texts here")
_PARAGRAPHS = ("the model keeps its memory across tasks and more", "ab12x", "several tokens shared both here texts between", "nothing")
_NORMAL = "lower(trim(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')))"
_TOKEN = "list_distinct(list_filter(regexp_extract_all(trim(regexp_replace({}, '[^a-z0-9]+', ' ', 'g')), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ('the','and','for','with','from','this','that','into','are','was','were')))"


@query(f"""WITH l AS (SELECT o_custkey AS doc_id, o_orderkey AS line_index, {_NORMAL.format(picked_sql("o_orderkey", _SEEN))} AS n FROM orders), p AS (SELECT o_custkey AS doc_id, {_NORMAL.format(picked_sql("o_orderkey // 2", _PARAGRAPHS))} AS pn FROM orders WHERE o_orderkey % 4 = 0),
lt AS (SELECT *, regexp_replace(n, '[^a-z0-9]+', '', 'g') AS c, {_TOKEN.format("n")} AS t FROM l), pt AS (SELECT *, regexp_replace(pn, '[^a-z0-9]+', '', 'g') AS pc, {_TOKEN.format("pn")} AS w FROM p)
SELECT doc_id, line_index FROM lt l WHERE NOT EXISTS (SELECT 1 FROM pt p WHERE p.doc_id = l.doc_id AND (contains(pn, n) OR (length(n) >= 20 AND contains(pn, substr(n, 1, 20))) OR (length(c) >= 20 AND contains(pc, c)) OR (len(list_intersect(t, w)) >= 6 AND len(list_intersect(t, w)) >= 0.6 * len(t))))""")
def untracked_lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("half", F.expr("o_orderkey div 2"))
    lines = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_index"), picked("o_orderkey", _SEEN).alias("text"))
    return align.tracked(lines, o.where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("doc_id"), picked("half", _PARAGRAPHS).alias("input"))).select("doc_id", "line_index")


@query(f"""WITH l AS (SELECT o_custkey AS doc_id, o_orderkey % 3 AS page, o_orderkey AS line_index, {_NORMAL.format(picked_sql("o_orderkey", _SEEN))} AS n FROM orders),
p AS (SELECT o_custkey AS doc_id, 'p' || o_orderkey::VARCHAR AS debug_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 3 END AS pp, o_orderkey % 2 = 0 AS crosses, {_NORMAL.format(picked_sql("o_orderkey // 2", _PARAGRAPHS))} AS pn FROM orders WHERE o_orderkey % 4 <> 0),
m AS (SELECT l.doc_id, debug_id, l.page, line_index FROM l JOIN p ON l.doc_id = p.doc_id AND length(n) >= 4 AND (pp IS NULL OR page = pp OR (crosses AND abs(page - pp) = 1)) AND (contains(n, pn) OR contains(pn, n) OR len(list_intersect(list_distinct(string_split(n, ' ')), list_distinct(string_split(pn, ' ')[:18]))) >= 5))
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, debug_id ORDER BY page, line_index) = 1""")
def sources_still_visible(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("half", F.expr("o_orderkey div 2"))
    k = F.col("o_orderkey")
    lines = o.select(F.col("o_custkey").alias("doc_id"), (k % 3).alias("page"), k.alias("line_index"), picked("o_orderkey", _SEEN).alias("text"))
    p = o.where("o_orderkey % 4 <> 0").select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("p"), k.cast("string")).alias("debug_id"), F.when(k % 5 != 0, k % 3).alias("page"), (k % 2 == 0).alias("crosses"), picked("half", _PARAGRAPHS).alias("input"), F.lit("译文").alias("output"))
    return align.visible_after_translation(lines, p).select("doc_id", "debug_id", "page", "line_index")


# --- research records -------------------------------------------------------------------------------

_REPORT = "# Summary\n\nWe found that prices rose sharply over the last year in all of the regions that we looked at closely [S1].\n\n# Scope\nAll shops [S2].\n\n| a | b | c |\n| --- | --- | --- |\n| prices fell | [S1] | x |\n\n# Limits\nFew data.\n# Sources\n[S1] one [S2] two [Q1](link)"
_REPORTS = (_REPORT, _REPORT.replace("# Scope", "# Other"), "# Summary\nshort [S9]", "# Summary\n# Summary\n" + _REPORT)
_CHOSEN = ("# Summary", "# Scope", "# Limits", "# Sources")
_RESEARCH = ("complete", "partial", "blocked")
_BUNDLES = f"(SELECT c_custkey AS bundle_id, {picked_sql('c_custkey', _RESEARCH)} AS research_status, {picked_sql('c_custkey', _REPORTS)} AS report FROM customer)"


def _bundles(spark, sf_dir):
    headings = F.create_map(*[x for s, h in zip(research.REPORT_SECTIONS, _CHOSEN) for x in (F.lit(s), F.when((F.lit(s) == "sources") & (F.col("c_custkey") % 5 == 0), "# Summary").otherwise(h))])
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bundle_id"), picked("c_custkey", _RESEARCH).alias("research_status"), picked("c_custkey", _REPORTS).alias("report"), headings.alias("report_sections"))


def _args(df):
    return df.select("bundle_id", "code", F.array_join("args", "|").alias("args"))


@query(f"""WITH w AS (SELECT bundle_id, report, s AS section, CASE WHEN s = 'sources' AND bundle_id % 5 = 0 THEN '# Summary' ELSE h END AS heading FROM {_BUNDLES}, (VALUES {", ".join(f"({quoted(s)}, {quoted(h)})" for s, h in zip(research.REPORT_SECTIONS, _CHOSEN))}) v(s, h))
SELECT bundle_id, 'report_section_missing' AS code, section AS args FROM w WHERE NOT list_contains(list_transform(string_split(report, chr(10)), lambda x: trim(x)), heading) UNION ALL SELECT bundle_id, 'report_sections_not_distinct', '' FROM {_BUNDLES} WHERE bundle_id % 5 = 0
UNION ALL SELECT bundle_id, 'report_too_short', '' FROM {_BUNDLES} WHERE length(regexp_replace(report, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) < 100""")
def report_section_findings(spark, sf_dir):
    return _args(research.check_report_sections(_bundles(spark, sf_dir)))


_UNITS = rf"""(WITH l AS (SELECT bundle_id, generate_subscripts(r, 1) AS pos, unnest(r) AS line FROM (SELECT bundle_id, string_split(report, chr(10)) AS r FROM {_BUNDLES})), a AS (SELECT *, starts_with(trim(line), '|') AND ends_with(trim(line), '|') AND len(regexp_extract_all(line, '\|')) >= 3 AS is_row, trim(line) = '' AS blank FROM l),
b AS (SELECT *, is_row OR (NOT is_row AND NOT blank AND NOT coalesce(lag(NOT is_row AND NOT blank) OVER (PARTITION BY bundle_id ORDER BY pos), false)) AS start FROM a), c AS (SELECT *, sum(start::INT) OVER (PARTITION BY bundle_id ORDER BY pos) AS island FROM b)
SELECT bundle_id, trim(string_agg(line, chr(10) ORDER BY pos)) AS unit FROM c WHERE NOT blank AND NOT (is_row AND regexp_full_match(trim(line), '\|(?:\s*:?-{{3,}}:?\s*\|)+')) GROUP BY bundle_id, island)"""


@query(f"SELECT bundle_id, unit FROM {_UNITS}")
def report_units(spark, sf_dir):
    return research.evidence_units(_bundles(spark, sf_dir))


_CLAIMS = ("prices rose sharply", "All shops", "prices fell", "Few data", "nowhere")
_CITED = ("S1", "S2|S1", "S1", "S3", "S2")


@query(f"""WITH k AS (SELECT o_custkey AS bundle_id, 'C' || o_orderkey::VARCHAR AS claim_id, {picked_sql("o_orderkey", _CLAIMS)} AS claim, unnest(string_split({picked_sql("o_orderkey", _CITED)}, '|')) AS source_id FROM orders)
SELECT bundle_id, claim_id, source_id, EXISTS (SELECT 1 FROM {_UNITS} u WHERE u.bundle_id = k.bundle_id AND contains(unit, claim) AND contains(unit, '[' || source_id || ']') AND NOT contains(unit, '[' || source_id || '](')) AS bound FROM k""")
def claims_bound(spark, sf_dir):
    claims = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bundle_id"), F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("claim_id"), picked("o_orderkey", _CLAIMS).alias("claim"), F.split(picked("o_orderkey", _CITED), "\\|").alias("source_ids"))
    return align.bound_claims(research.evidence_units(_bundles(spark, sf_dir)), claims)


_LISTS = ("official_document|journalism", "journalism|journalism", "", None, "rumour", " other |journalism", "a||b")


@query(f"""WITH q AS (SELECT o_custkey AS bundle_id, 'Q' || o_orderkey::VARCHAR AS id, CASE WHEN s = '' THEN [] ELSE string_split(s, '|') END AS v FROM (SELECT *, {picked_sql("o_orderkey", _LISTS)} AS s FROM orders)), b AS (SELECT *, v IS NULL OR len(list_filter(v, lambda x: trim(x) = '')) > 0 AS bad, list_transform(v, lambda x: trim(x)) AS t FROM q)
SELECT bundle_id, 'kinds' AS code, id AS args FROM b WHERE bad UNION ALL SELECT bundle_id, 'kinds_duplicate', id FROM b WHERE NOT bad AND len(t) <> len(list_distinct(t)) UNION ALL SELECT bundle_id, 'kinds_empty', id FROM b WHERE NOT bad AND len(t) = 0
UNION ALL SELECT bundle_id, 'kinds_invalid', id || '|' || x FROM (SELECT bundle_id, id, unnest(t) AS x FROM b WHERE NOT bad) WHERE x NOT IN ({", ".join(map(quoted, research.SOURCE_KINDS))})""")
def list_findings(spark, sf_dir):
    s = picked("o_orderkey", _LISTS)
    q = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bundle_id"), F.concat(F.lit("Q"), F.col("o_orderkey").cast("string")).alias("question_id"), F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, "\\|")).alias("kinds"))
    return _args(research.string_lists(q, "kinds", "question_id", "kinds", research.SOURCE_KINDS, True))


_REVIEWS = ("pass", "fail", None, "not_reviewed")


@query(f"""WITH b AS (SELECT bundle_id, research_status, coalesce({picked_sql("bundle_id // 3", _REVIEWS)}, 'not_reviewed') AS r FROM {_BUNDLES}), n AS (SELECT o_custkey AS bundle_id, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY o_custkey)
SELECT bundle_id, CASE WHEN n.n IS NOT NULL THEN 'invalid' ELSE CASE research_status || '/' || r WHEN 'complete/not_reviewed' THEN 'complete_draft' WHEN 'complete/pass' THEN 'reviewed_pass' WHEN 'complete/fail' THEN 'reviewed_fail' WHEN 'partial/not_reviewed' THEN 'partial' WHEN 'partial/fail' THEN 'partial' WHEN 'blocked/not_reviewed' THEN 'blocked' WHEN 'blocked/fail' THEN 'blocked' ELSE 'invalid' END END AS delivery_status, coalesce(n.n, 0) AS n_errors FROM b LEFT JOIN n USING (bundle_id)""")
def bundle_deliveries(spark, sf_dir):
    b = _bundles(spark, sf_dir)
    reviews = b.withColumn("third", F.expr("bundle_id div 3")).select("bundle_id", picked("third", _REVIEWS).alias("review_status"))
    found = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("bundle_id"))
    return research.delivery_status(b, reviews, found)


@query("""WITH a AS (SELECT o_custkey AS bundle_id, o_orderkey FROM orders), i AS (SELECT bundle_id, 'Q' || (o_orderkey % 6)::VARCHAR AS id, 'question' AS k FROM a UNION ALL SELECT bundle_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Q' ELSE 'S' END || (o_orderkey % 8)::VARCHAR, 'source' FROM a UNION ALL SELECT bundle_id, 'C' || o_orderkey::VARCHAR, 'claim' FROM a)
SELECT bundle_id, 'identifier_namespace_collision' AS code, id AS args FROM i GROUP BY bundle_id, id HAVING count(DISTINCT k) > 1""")
def colliding_ids(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "bundle_id")
    q = o.select("bundle_id", F.concat(F.lit("Q"), (k % 6).cast("string")).alias("question_id"))
    s = o.select("bundle_id", F.concat(F.when(k % 2 == 0, "Q").otherwise("S"), (k % 8).cast("string")).alias("source_id"))
    return _args(research.namespace_collisions(q, s, o.select("bundle_id", F.concat(F.lit("C"), k.cast("string")).alias("claim_id"))))


@query("""WITH d AS (SELECT o_custkey AS bundle_id, 'Q' || o_orderkey::VARCHAR AS q, unnest(CASE o_orderkey % 3 WHEN 0 THEN ['journalism', 'other'] WHEN 1 THEN ['other'] ELSE [] END) AS item FROM orders), c AS (SELECT o_custkey AS bundle_id, 'Q' || o_orderkey::VARCHAR AS q, 'other' AS item FROM orders WHERE o_orderkey % 2 = 0)
SELECT bundle_id, 'stop_gap_not_derived' AS code, 'source_kind|' || q || '|' || item AS args FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM d) UNION ALL SELECT bundle_id, 'stop_gap_not_declared', 'source_kind|' || q || '|' || item FROM (SELECT * FROM d EXCEPT ALL SELECT * FROM c)""")
def stop_gaps(spark, sf_dir):
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bundle_id"), k, F.concat(F.lit("Q"), k.cast("string")).alias("question_id"))
    kinds = F.when(k % 3 == 0, F.array(F.lit("journalism"), F.lit("other"))).when(k % 3 == 1, F.array(F.lit("other"))).otherwise(none)
    d = o.select("bundle_id", "question_id", kinds.alias("missing_source_kinds"), *[none.alias(f"missing_{c}") for c in ("checks", "objects", "dimensions")])
    return _args(research.check_stop(o.where(k % 2 == 0).select("bundle_id", F.lit("source_kind").alias("gap_type"), "question_id", F.lit("other").alias("item")), d))


@query("""WITH i AS (SELECT o_custkey AS bundle_id, CASE WHEN o_orderkey % 2 = 0 THEN 'claim' ELSE 'source' END AS kind, (o_orderkey % 9)::VARCHAR AS id FROM orders), m AS (SELECT bundle_id, kind, count(*) AS m FROM i GROUP BY ALL), r AS (SELECT c_custkey AS bundle_id, 'claim' AS kind, c_custkey % 8 AS n FROM customer), x AS (SELECT c_custkey AS bundle_id, 'claim' AS kind, '4' AS id FROM customer),
t AS (SELECT bundle_id, kind, id, count(*) AS c FROM i GROUP BY ALL)
SELECT coalesce(r.bundle_id, m.bundle_id) AS bundle_id, 'review_count_mismatch' AS code, coalesce(r.kind, m.kind) AS args FROM r FULL OUTER JOIN m ON r.bundle_id = m.bundle_id AND r.kind = m.kind WHERE coalesce(n, 0) <> coalesce(m, 0) UNION ALL SELECT bundle_id, 'review_item_missing', 'claim|4' FROM x WHERE (bundle_id, kind, id) NOT IN (SELECT (bundle_id, kind, id) FROM t)
UNION ALL SELECT bundle_id, 'review_item_duplicate', kind || '|' || id FROM t WHERE c > 1 UNION ALL SELECT c_custkey, 'review_candidate_hash_mismatch', 'report' FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 4 = 0""")
def review_findings(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "bundle_id")
    items = o.select(F.col("o_custkey").alias("bundle_id"), F.when(F.col("o_orderkey") % 2 == 0, "claim").otherwise("source").alias("kind"), (F.col("o_orderkey") % 9).cast("string").alias("id"))
    declared = c.select("bundle_id", F.lit("claim").alias("kind"), (F.col("bundle_id") % 8).alias("n"))
    expected = c.select("bundle_id", F.lit("claim").alias("kind"), F.lit("4").alias("id"))
    now = c.select("bundle_id", F.lit("report").alias("file"), F.when(F.col("bundle_id") % 3 == 0, "new").otherwise("h").alias("sha256"))
    return _args(research.check_review(declared, items, expected, c.where("bundle_id % 4 <> 0").select("bundle_id", F.lit("report").alias("file"), F.lit("h").alias("sha256")), now))


# --- routes -----------------------------------------------------------------------------------------

_ASKED = ("家里共享旅行计划 budget", "备考 国考 schedule", "客户发票 invoice", "plain request", "孕期用药 health diary", None)
_DOMAINS = ("travel-planning", "exam-preparation", "finance-tax-contract", "unknown", "health-pregnancy")
_PACKS = (("travel-planning", ("budget", "plan"), ("external-side-effect",)), ("exam-preparation", ("schedule",), ()), ("finance-tax-contract", ("invoice", "budget"), ("financial-data",)), ("health-pregnancy", ("diary", "health"), ("health-data",)))


def _requests(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    aux = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("exam-preparation"), F.lit("other"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("travel-planning"), F.lit("travel-planning")))
    spans = F.when(F.col("c_custkey") % 4 != 0, F.array(F.lit("budget"))).otherwise(F.array().cast("array<string>"))
    return c.select(F.col("c_custkey").alias("request_id"), picked("c_custkey", _ASKED).alias("text"), picked("c_custkey", _DOMAINS).alias("primary_domain"), aux.alias("auxiliary_domains"), spans.alias("evidence_spans"), F.when(F.col("c_custkey") % 2 == 0, "p1").alias("profile_id"))


def _packs(spark):
    return spark.createDataFrame([(d, list(k), list(r)) for d, k, r in _PACKS], "domain_id string, keywords array<string>, risk_triggers array<string>")


_ASKED_SQL = f"(SELECT c_custkey AS request_id, {picked_sql('c_custkey', _ASKED)} AS text, {picked_sql('c_custkey', _DOMAINS)} AS domain FROM customer)"


@query(f"""WITH w(d, word, points) AS (VALUES {", ".join([f"({quoted(d)}, {quoted(w)}, 2)" for d, ws, _ in _PACKS for w in ws] + [f"({quoted(d)}, {quoted(w)}, 8)" for d, ws in routing.ANCHORS for w in ws if d in [p[0] for p in _PACKS]])})
SELECT request_id, d AS domain_id, sum(points)::BIGINT AS score, row_number() OVER (PARTITION BY request_id ORDER BY sum(points) DESC, d) AS rank FROM {_ASKED_SQL} JOIN w ON contains(lower(coalesce(text, '')), lower(word)) GROUP BY request_id, d""")
def routed_domains(spark, sf_dir):
    return routing.route_scores(_requests(spark, sf_dir), _packs(spark)).select("request_id", "domain_id", F.col("score").cast("long"), F.col("rank").cast("long"))


@query(f"""WITH w(risk, word) AS (VALUES {", ".join(f"({quoted(r)}, {quoted(w)})" for r, ws in routing.RISK_WORDS for w in ws)}), p(d, risk) AS (VALUES {", ".join(f"({quoted(d)}, {quoted(r)})" for d, _, rs in _PACKS for r in rs)}),
x AS (SELECT request_id, domain AS d FROM {_ASKED_SQL} UNION ALL SELECT c_custkey, unnest(CASE c_custkey % 3 WHEN 0 THEN ['exam-preparation', 'other'] WHEN 1 THEN ['travel-planning', 'travel-planning'] ELSE [] END) FROM customer)
SELECT request_id, string_agg(DISTINCT risk, ',' ORDER BY risk) AS risks FROM (SELECT request_id, risk FROM {_ASKED_SQL} JOIN w ON contains(lower(coalesce(text, '')), lower(word)) UNION ALL SELECT request_id, risk FROM x JOIN p USING (d)) GROUP BY request_id""")
def request_risks(spark, sf_dir):
    return routing.risks(_requests(spark, sf_dir), _packs(spark)).select("request_id", F.array_join("risks", ",").alias("risks"))


_KNOWN = ", ".join(quoted(d) for d, _, _ in _PACKS)


@query(f"""SELECT request_id, 'primary_domain_invalid' AS code FROM {_ASKED_SQL} WHERE domain NOT IN ({_KNOWN}) UNION ALL SELECT request_id, 'auxiliary_domains_invalid' FROM {_ASKED_SQL} WHERE request_id % 3 = 1 OR (request_id % 3 = 0 AND domain = 'exam-preparation') UNION ALL SELECT request_id, 'auxiliary_domain_unknown' FROM {_ASKED_SQL} WHERE request_id % 3 = 0
UNION ALL SELECT request_id, 'evidence_span_invalid' FROM {_ASKED_SQL} WHERE request_id % 4 = 0 OR NOT contains(coalesce(text, ''), 'budget') UNION ALL SELECT request_id, 'profile_invalid' FROM {_ASKED_SQL} WHERE request_id % 2 = 0 AND domain NOT IN ('travel-planning', 'exam-preparation')""")
def route_faults(spark, sf_dir):
    profiles = spark.createDataFrame([("travel-planning", "p1"), ("exam-preparation", "p1")], "domain_id string, profile_id string")
    return routing.route_errors(_requests(spark, sf_dir), _packs(spark), profiles)


_OFFERS = tuple((_DOMAINS[i % 3], i, f"m{i % 9}") for i in range(24))


@query(f"""WITH o(d, pos, m) AS (VALUES {", ".join(f"({quoted(d)}, {p}, {quoted(m)})" for d, p, m in _OFFERS)}), l AS (SELECT d, list(m ORDER BY pos) AS offer FROM o GROUP BY d), r AS (SELECT request_id, list_concat(CASE WHEN request_id % 2 = 0 THEN ['m1', 'x'] ELSE [] END, coalesce(offer, [])) AS v FROM {_ASKED_SQL} LEFT JOIN l ON d = domain),
k AS (SELECT request_id, list_filter(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN list_position(v, v[i]) = i THEN v[i] END), lambda x: x IS NOT NULL) AS v FROM r)
SELECT request_id, array_to_string(v[:4], ',') AS core, array_to_string(v[5:], ',') AS optional FROM k""")
def recommended_modules(spark, sf_dir):
    r = _requests(spark, sf_dir).withColumn("explicit_modules", F.when(F.col("request_id") % 2 == 0, F.array(F.lit("m1"), F.lit("x"))))
    out = routing.recommend(r, spark.createDataFrame(list(_OFFERS), "domain_id string, pos int, module_id string"), 4)
    return out.select("request_id", F.array_join("core", ",").alias("core"), F.array_join("optional", ",").alias("optional"))


@query("""WITH s AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 's' || (o_orderkey % 400)::VARCHAR END AS source_id, o_orderkey % 2 = 0 AS t, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'x' END AS c FROM orders)
SELECT source_id, 'duplicate' AS code FROM s WHERE source_id IS NOT NULL GROUP BY source_id HAVING count(*) > 1 UNION ALL SELECT source_id, 'missing' FROM s WHERE source_id IS NULL UNION ALL SELECT source_id, 'captured_at_missing' FROM s WHERE t AND trim(c) = ''""")
def registry_faults(spark, sf_dir):
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select(F.when(k % 7 != 0, F.concat(F.lit("s"), (k % 400).cast("string"))).alias("source_id"), (k % 2 == 0).alias("time_sensitive"), F.when(k % 3 == 0, " ").otherwise("x").alias("captured_at"))
    return routing.source_registry_errors(s)


_ITEMS = "(SELECT p_brand AS domain_id, p_type || (p_size % 4)::VARCHAR AS module_id, p_partkey AS item_id, p_size % 7 AS k FROM part)"


@query(f"""SELECT domain_id AS key, 'domain_items' AS code, count(*) AS n FROM {_ITEMS} GROUP BY domain_id HAVING count(*) < 12 UNION ALL SELECT module_id, 'module_items', count(*) FROM {_ITEMS} GROUP BY module_id HAVING NOT count(*) BETWEEN 6 AND 10 UNION ALL SELECT module_id, 'knowledge_points', count(DISTINCT k) FROM {_ITEMS} GROUP BY module_id HAVING count(DISTINCT k) < 6""")
def catalog_faults(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("domain_id"), F.concat("p_type", (F.col("p_size") % 4).cast("string")).alias("module_id"), F.col("p_partkey").alias("item_id"), (F.col("p_size") % 7).alias("knowledge_point"))
    return routing.catalog_errors(p)


_DECISIONS = ((1, "financial-data", "d1", "Who may see it?"), (2, "health-data", "d2", "Is a doctor asked?"), (3, "financial-data", "d3", "Which currency?"), (4, "multi-user", "d1", "Who shares?"), (5, "external-side-effect", "d4", "May it send?"), (6, "child-data", "d5", "How old?"))


@query(f"""WITH d(pos, risk, id, question) AS (VALUES {", ".join(f"({p}, {quoted(r)}, {quoted(i)}, {quoted(t)})" for p, r, i, t in _DECISIONS)}), w(risk, word) AS (VALUES {", ".join(f"({quoted(r)}, {quoted(w)})" for r, ws in routing.RISK_WORDS for w in ws)}),
x AS (SELECT DISTINCT request_id, risk FROM {_ASKED_SQL} JOIN w ON contains(lower(coalesce(text, '')), lower(word)))
SELECT request_id, id AS decision_id, min(pos) AS pos, arg_min(question, pos) AS question FROM x JOIN d USING (risk) GROUP BY request_id, id QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY min(pos), id) <= 2""")
def critical_questions(spark, sf_dir):
    words = spark.createDataFrame([(d, [], []) for d in ("none",)], "domain_id string, keywords array<string>, risk_triggers array<string>")
    raised = routing.risks(_requests(spark, sf_dir), words)
    return routing.critical_decisions(_requests(spark, sf_dir), raised, spark.createDataFrame(list(_DECISIONS), "pos int, risk string, decision_id string, question string"), 2)


@query("""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN ' ' ELSE p_name END AS title, p_brand AS d, [p_type, p_type || (p_size % 2)::VARCHAR, 'x'] || CASE WHEN p_size % 5 = 0 THEN ['x'] ELSE [] END AS m FROM part), u AS (SELECT id, d, unnest(m) AS m FROM p), offered AS (SELECT DISTINCT p_brand AS d, unnest([p_type, 'x']) AS m FROM part WHERE p_size > 10)
SELECT id AS product_id, 'field_missing' AS code, 'title' AS detail FROM p WHERE trim(title) = '' UNION ALL SELECT id, 'field_missing', 'summary' FROM p WHERE id % 4 = 0 UNION ALL SELECT id, 'module_duplicate', m FROM u GROUP BY id, m HAVING count(*) > 1 UNION ALL SELECT id, 'module_not_offered', m FROM u WHERE (d, m) NOT IN (SELECT (d, m) FROM offered) UNION ALL SELECT id, 'source_unknown', (id % 9)::VARCHAR FROM p WHERE id % 9 > 5""")
def product_faults(spark, sf_dir):
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    more = F.when(F.col("p_size") % 5 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    p = part.select(k.alias("product_id"), F.when(k % 10 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.col("p_brand").alias("domain_id"), F.when(k % 4 != 0, "s").alias("summary"), F.concat(F.array("p_type", F.concat("p_type", (F.col("p_size") % 2).cast("string")), F.lit("x")), more).alias("modules"), F.array((k % 9).cast("string")).alias("source_ids"))
    offered = part.where("p_size > 10").select(F.col("p_brand").alias("domain_id"), F.explode(F.array("p_type", F.lit("x"))).alias("module_id")).distinct()
    return routing.product_errors(p, offered, spark.createDataFrame([(str(i),) for i in range(6)], "source_id string"))


_TEMPLATES = ((1, "t1", ("BUILDING",), (), (), ("red",), ()), (2, "t2", ("BUILDING", "MACHINERY"), ("even",), ("m1",), (), ("blue",)), (3, "t3", ("MACHINERY", "HOUSEHOLD"), (), (), (), ("red",)))
_WISHES = ("red room", "blue room", "plain", None)


@query(f"""WITH c AS (SELECT c_custkey AS product_id, c_mktsegment AS d, CASE WHEN c_custkey % 2 = 0 THEN 'even' END AS p, c_custkey % 3 = 0 AS has_m1, coalesce({picked_sql("c_custkey", _WISHES)}, '') AS r FROM customer)
SELECT product_id, CASE WHEN d = 'BUILDING' AND contains(r, 'red') THEN 't1' WHEN d IN ('BUILDING', 'MACHINERY') AND coalesce(p = 'even', false) AND has_m1 AND NOT contains(r, 'blue') THEN 't2' ELSE 't3' END AS template_id FROM c
WHERE (d = 'BUILDING' AND contains(r, 'red')) OR (d IN ('BUILDING', 'MACHINERY') AND coalesce(p = 'even', false) AND has_m1 AND NOT contains(r, 'blue')) OR (d IN ('MACHINERY', 'HOUSEHOLD') AND NOT contains(r, 'red'))""")
def fitting_templates(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("product_id"), F.col("c_mktsegment").alias("domain_id"), F.when(k % 2 == 0, "even").alias("profile_id"), F.when(k % 3 == 0, F.array(F.lit("m1"))).otherwise(F.array(F.lit("m2"))).alias("modules"), picked("c_custkey", _WISHES).alias("request"))
    t = spark.createDataFrame([(p, i, *map(list, rest)) for p, i, *rest in _TEMPLATES], "pos int, template_id string, domains array<string>, profiles array<string>, required_modules array<string>, markers array<string>, excluded array<string>")
    return routing.match_template(c, t)


# --- rounds, prompts, starters, built pages ---------------------------------------------------------

_ROUND_TYPES = ("main_research", "coverage_gap_check", "adversarial_saturation_check", "main_research", "odd")
_ROUNDS = f"(SELECT o_custkey AS bundle_id, 'R' || (o_orderkey % 700)::VARCHAR AS round_id, o_orderkey AS pos, {picked_sql('o_orderkey', _ROUND_TYPES)} AS t, CASE o_orderkey % 3 WHEN 0 THEN ['Q1'] WHEN 1 THEN ['Q1', 'Q2'] ELSE ['Q2', 'Q9'] END AS q, CASE WHEN o_orderkey % 4 = 0 THEN ['Q1', 'Q7'] END AS keys FROM orders)"


@query(f"""WITH r AS {_ROUNDS}, q AS (SELECT c_custkey AS bundle_id, unnest(['Q1', 'Q2']) AS question FROM customer), c AS (SELECT * FROM q WHERE bundle_id % 2 = 0), u AS (SELECT bundle_id, round_id, pos, t, unnest(q) AS question FROM r),
k AS (SELECT bundle_id, question, list_distinct(list(t)) AS have, min(pos) FILTER (WHERE t = 'main_research') AS main, max(pos) FILTER (WHERE t = 'adversarial_saturation_check') AS check_ FROM u GROUP BY ALL),
m AS (SELECT c.*, coalesce(have, []) AS have, main, check_ FROM c LEFT JOIN k USING (bundle_id, question)), g AS (SELECT m.bundle_id, m.question, bool_or(coalesce(main < u.pos AND u.pos < check_, false)) AS ok FROM m JOIN u ON u.bundle_id = m.bundle_id AND u.question = m.question AND u.t = 'coverage_gap_check' WHERE main IS NOT NULL AND check_ IS NOT NULL GROUP BY ALL)
SELECT bundle_id, 'duplicate_research_round_id' AS code, round_id AS args FROM r GROUP BY bundle_id, round_id HAVING count(*) > 1 UNION ALL SELECT bundle_id, 'research_round_type_invalid', round_id FROM r WHERE t = 'odd' UNION ALL SELECT bundle_id, 'research_round_unknown_question', round_id || '|Q9' FROM r WHERE list_contains(q, 'Q9')
UNION ALL SELECT bundle_id, 'research_round_strategy_types_unknown_question', round_id || '|' || x FROM (SELECT bundle_id, round_id, unnest(list_filter(keys, lambda x: NOT list_contains(q, x))) AS x FROM r WHERE keys IS NOT NULL) UNION ALL SELECT bundle_id, 'research_round_strategy_types_missing_question', round_id || '|' || x FROM (SELECT bundle_id, round_id, unnest(list_filter(q, lambda x: NOT list_contains(keys, x))) AS x FROM r WHERE keys IS NOT NULL)
UNION ALL SELECT bundle_id, 'research_round_question_not_covered', question || '|' || x FROM (SELECT bundle_id, question, unnest(list_filter(['main_research', 'coverage_gap_check', 'adversarial_saturation_check'], lambda x: NOT list_contains(have, x))) AS x FROM m) UNION ALL SELECT bundle_id, 'research_round_order_invalid', question FROM g WHERE NOT ok""")
def round_findings(spark, sf_dir):
    k = F.col("o_orderkey")
    targets = F.when(k % 3 == 0, F.array(F.lit("Q1"))).when(k % 3 == 1, F.array(F.lit("Q1"), F.lit("Q2"))).otherwise(F.array(F.lit("Q2"), F.lit("Q9")))
    mapped = lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda _: F.array(F.lit("x"))))
    other = F.when(k % 4 == 0, F.array(F.lit("Q1"), F.lit("Q7"))).otherwise(targets)
    rounds = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bundle_id"), F.concat(F.lit("R"), (k % 700).cast("string")).alias("round_id"), k.alias("pos"), picked("o_orderkey", _ROUND_TYPES).alias("round_type"), targets.alias("target_question_ids"), mapped(other).alias("strategy_types"), *[mapped(targets).alias(c) for c in ("checks_completed", "objects_checked", "dimensions_checked")])
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bundle_id"), F.when(F.col("c_custkey") % 2 == 0, "complete").otherwise("partial").alias("research_status"))
    return _args(research.check_rounds(c, c.select("bundle_id", F.explode(F.array(F.lit("Q1"), F.lit("Q2"))).alias("question_id")), rounds))


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05)""")
def rows_without_partner(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    return align.missing(table(spark, sf_dir, "orders").select("o_orderkey"), seen, ["o_orderkey"])


_DICTIONARY = (("title", "Red  Widget", "红色部件"), ("title", "small ring", "小环"), ("body", "red widget", "部件"))


@query(f"""WITH d(role, source, output) AS (VALUES {", ".join(f"({quoted(r)}, {quoted(s)}, {quoted(o)})" for r, s, o in _DICTIONARY)}), p AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN 'title' ELSE 'body' END AS role, upper(p_name) AS text FROM part)
SELECT p_partkey, output AS direct FROM p LEFT JOIN d ON d.role = p.role AND lower({collapsed("d.source")}) = lower({collapsed("p.text")})""")
def dictionary_by_role(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, "title").otherwise("body").alias("role"), F.upper("p_name").alias("text"))
    return rewrites.role_dictionary(p, spark.createDataFrame(list(_DICTIONARY), "role string, source string, output string")).select("p_partkey", "direct")


@query("""SELECT p_partkey FROM part WHERE (p_type = 'ECONOMY' AND p_size % 3 = 1 AND contains(p_name, 'red')) OR (p_type = 'STANDARD' AND regexp_matches(p_name, '^small'))""")
def lines_allowed(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("profile"), (F.col("p_size") % 3).alias("page"), F.col("p_name").alias("text"))
    rules = spark.createDataFrame([("ECONOMY", 1, "red"), ("STANDARD", None, "^small"), ("STANDARD", 2, "^small")], "profile string, page int, pattern string")
    return rewrites.allowed_by_profile(p, rules).select("p_partkey")


_POLICY = ((1, "widget", "部件", "a part"), (2, "red", "红", ""), (3, "small ring", "小环", None), (4, "C++", "C++", "keep"), (5, "bolt", "", "x"))


@query(f"""WITH t(pos, term, expected, note) AS (VALUES {", ".join(f"({p}, {quoted(t)}, {quoted(e)}, {quoted(n)})" for p, t, e, n in _POLICY)}), b AS (SELECT p_partkey AS block_id, p_name || CASE WHEN p_size % 4 = 0 THEN ' in C++' ELSE '' END AS text FROM part),
r AS (SELECT block_id, substr('- ' || term || ' => ' || expected || CASE WHEN coalesce(note, '') <> '' THEN ' ' || note ELSE '' END, 1, 260) AS w, row_number() OVER (PARTITION BY block_id ORDER BY CASE WHEN regexp_matches(term, '^[A-Za-z0-9]+$') THEN list_contains(regexp_extract_all(text, '[A-Za-z0-9]+'), term) ELSE contains(text, term) END DESC, pos) AS n FROM b, t)
SELECT block_id, string_agg(w, chr(10) ORDER BY n) AS context FROM r WHERE n <= 3 GROUP BY block_id""")
def prompt_contexts(spark, sf_dir):
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("block_id"), F.concat("p_name", F.when(F.col("p_size") % 4 == 0, " in C++").otherwise("")).alias("text"))
    return rewrites.policy_context(b, spark.createDataFrame(list(_POLICY), "pos int, term string, expected string, note string"), most=3)


_STARTERS, _OWN = tuple((f"c{i % 4}", f"i{i}", f"question {i}", i) for i in range(12)), (("c1", "s1", "i1", "own question", 0), ("c2", "s2", "i9", "another", 3), ("c2", "s2", "i9", "later", 4))


@query(f"""WITH i(c, id, question, pos) AS (VALUES {", ".join(f"({quoted(c)}, {quoted(i)}, {quoted(t)}, {p})" for c, i, t, p in _STARTERS)}), o(c, stage, id, question, pos) AS (VALUES {", ".join(f"({quoted(c)}, {quoted(s)}, {quoted(i)}, {quoted(t)}, {p})" for c, s, i, t, p in _OWN)}),
m AS (SELECT p_partkey AS m, 's' || (p_size % 3)::VARCHAR AS stage, unnest(['c' || (p_size % 4)::VARCHAR, 'c' || (p_partkey % 4)::VARCHAR]) AS c FROM part), x AS (SELECT m, id, question, pos, 0 AS own FROM m JOIN i USING (c) UNION ALL SELECT m, id, question, pos, 1 FROM m JOIN o USING (c, stage)), k AS (SELECT *, max(own) OVER (PARTITION BY m) AS top FROM x)
SELECT m AS module_id, id AS item_id, arg_min(question, pos) AS question, min(pos) AS pos FROM k WHERE own = top GROUP BY m, id""")
def starters(spark, sf_dir):
    m = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("module_id"), F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string")).alias("stage_id"), F.array(*[F.concat(F.lit("c"), (F.col(c) % 4).cast("string")) for c in ("p_size", "p_partkey")]).alias("capabilities"))
    items = spark.createDataFrame(list(_STARTERS), "capability string, item_id string, question string, pos int")
    own = spark.createDataFrame([(c, s, i, t, p) for c, s, i, t, p in _OWN], "capability string, stage_id string, item_id string, question string, pos int")
    return routing.starter_items(m, items, own)


@query("""WITH p AS (SELECT page_id, page_id % 3 = 0 AS todo, page_id % 4 = 0 AS net, page_id % 5 = 0 AS wrong, page_id % 7 = 0 AS lacks, page_id % 2 = 0 AS drift FROM pages)
SELECT page_id, 'not_exact:data-run' AS code FROM p WHERE wrong UNION ALL SELECT page_id, 'missing:data-step' FROM p WHERE lacks UNION ALL SELECT page_id, 'forbidden:unfinished' FROM p WHERE todo UNION ALL SELECT page_id, 'forbidden:network' FROM p WHERE net UNION ALL SELECT page_id, 'hash_drift' FROM p WHERE drift""")
def built_page_faults(spark, sf_dir):
    k = F.col("page_id")
    html = F.concat(F.lit('<main data-run="r'), F.when(k % 5 == 0, F.lit("x")).otherwise(k.cast("string")), F.lit('"><p data-step="a">one</p>'), F.when(k % 7 != 0, '<p data-step="b">two</p>').otherwise(""), F.when(k % 3 == 0, "<i>TODO</i>").otherwise(""), F.when(k % 4 == 0, "<script>fetch('/x')</script>").otherwise(""), F.lit("</main>"))
    p = table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    locks = p.select("page_id", F.concat(F.lit("r"), k.cast("string")).alias("run"), F.when(k % 2 == 0, "old").otherwise(F.sha2("html", 256)).alias("candidate_sha256"))
    return rewrites.scan_candidates(p, locks, {"data-run": "run"}, {"data-step": ("a", "b")})


_STRATEGIES, _CHECKS, _OBJECTS, _IMPACTS = ("primary_sources", "counterevidence|freshness", "omission_scan", ""), ("freshness", "omitted_objects|freshness", ""), ("o1", "o2", ""), ("none", "changed", None, "odd", "none")
_NEEDED, _SOURCE_KIND, _ACCESS = ("official_document|journalism", "other", ""), ("journalism", "official_document", "other"), ("full_text", "metadata_only", "substantive_sections")
_SPLIT = "CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, '|') END"


def _split(c):
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, "\\|"))


@query(f"""WITH b AS (SELECT c_custkey AS bundle_id, CASE WHEN c_custkey % 3 = 0 THEN 'see [S1]' ELSE 'see [S1] and [S2]' END AS report FROM customer), q AS (SELECT bundle_id, unnest(['Q1', 'Q2']) AS question_id FROM b),
s AS (SELECT bundle_id, i, 'S' || i::VARCHAR AS id, {picked_sql("bundle_id + i", _SOURCE_KIND)} AS kind, {picked_sql("bundle_id * i", _ACCESS)} AS access, CASE WHEN (bundle_id + i) % 2 = 0 THEN 'independent' ELSE 'first_party' END AS rel, CASE WHEN i = 1 THEN ['Q1', 'Q2'] ELSE ['Q2'] END AS qs FROM b, (VALUES (1), (2)) v(i)),
h AS (SELECT bundle_id, question_id, list(kind) AS kinds, bool_or(rel = 'independent') AS ind FROM (SELECT s.bundle_id, unnest(qs) AS question_id, kind, rel FROM s JOIN b ON b.bundle_id = s.bundle_id WHERE access IN ('full_text', 'substantive_sections') AND contains(report, '[' || id || ']')) GROUP BY ALL),
r AS (SELECT o_custkey AS bundle_id, o_orderkey AS pos, {picked_sql("o_orderkey", _ROUND_TYPES)} AS t, unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['Q1'] ELSE ['Q1', 'Q2'] END) AS question_id, {_SPLIT.format(x=picked_sql("o_orderkey", _STRATEGIES))} AS strategies, {_SPLIT.format(x=picked_sql("o_orderkey", _CHECKS))} AS checks, {_SPLIT.format(x=picked_sql("o_orderkey", _OBJECTS))} AS objects, {picked_sql("o_orderkey // 2", _IMPACTS)} AS impact FROM orders),
l AS (SELECT * FROM r WHERE t = 'adversarial_saturation_check' AND impact IN ('changed', 'strengthened', 'narrowed', 'none') QUALIFY row_number() OVER (PARTITION BY bundle_id, question_id ORDER BY pos DESC) = 1),
n AS (SELECT bundle_id, question_id, flatten(list(objects)) AS objects, list_distinct(flatten(list(CASE WHEN t = 'main_research' THEN strategies ELSE [] END))) AS main FROM r GROUP BY ALL)
SELECT q.bundle_id, q.question_id, array_to_string(list_sort(list_filter({_SPLIT.format(x=picked_sql("q.bundle_id", _NEEDED))}, lambda x: NOT list_contains(coalesce(h.kinds, []), x))), ',') AS missing_source_kinds, q.bundle_id % 2 = 0 AND NOT coalesce(h.ind, false) AS independent_evidence_missing, array_to_string(list_sort(list_filter(['freshness', 'omitted_objects'], lambda x: NOT list_contains(coalesce(l.checks, []), x))), ',') AS missing_checks,
 array_to_string(list_sort(list_filter(['o1', 'o2'], lambda x: NOT list_contains(coalesce(n.objects, []), x))), ',') AS missing_objects, l.impact AS last_saturation_impact, EXISTS (SELECT 1 FROM r WHERE r.bundle_id = q.bundle_id AND r.question_id = q.question_id AND r.pos > l.pos AND coalesce(r.impact <> 'none', true)) AS changed_later,
 list_has_any(coalesce(l.strategies, []), ['independent_validation', 'counterevidence', 'freshness', 'omission_scan']) AS adversarial, list_sort(coalesce(l.strategies, [])) <> list_sort(coalesce(n.main, [])) AS distinct_strategy
FROM q LEFT JOIN h ON h.bundle_id = q.bundle_id AND h.question_id = q.question_id LEFT JOIN n ON n.bundle_id = q.bundle_id AND n.question_id = q.question_id LEFT JOIN l ON l.bundle_id = q.bundle_id AND l.question_id = q.question_id""")
def question_coverage(spark, sf_dir):
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    customer = table(spark, sf_dir, "customer")
    b = customer.select(c.alias("bundle_id"), F.when(c % 3 == 0, "see [S1]").otherwise("see [S1] and [S2]").alias("report"))
    strings = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    q = customer.select(c.alias("bundle_id"), F.explode(strings("Q1", "Q2")).alias("question_id"), _split(picked("c_custkey", _NEEDED)).alias("required_source_kinds"), (c % 2 == 0).alias("independent_evidence_required"), strings("freshness", "omitted_objects").alias("required_checks"), strings("o1", "o2").alias("required_objects"), strings().alias("required_dimensions"))
    s = customer.select(c.alias("bundle_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("i")).withColumns({"a": F.col("bundle_id") + F.col("i"), "m": F.col("bundle_id") * F.col("i")})
    s = s.select("bundle_id", F.concat(F.lit("S"), F.col("i").cast("string")).alias("source_id"), picked("a", _SOURCE_KIND).alias("source_kind"), picked("m", _ACCESS).alias("access_status"), F.when(F.col("a") % 2 == 0, "independent").otherwise("first_party").alias("stakeholder_relation"), F.when(F.col("i") == 1, strings("Q1", "Q2")).otherwise(strings("Q2")).alias("question_ids"))
    o = table(spark, sf_dir, "orders").withColumn("half", F.expr("o_orderkey div 2"))
    targets = F.when(k % 2 == 0, strings("Q1")).otherwise(strings("Q1", "Q2"))
    each = lambda v: F.map_from_arrays(targets, F.transform(targets, lambda _: v))
    rounds = o.select(F.col("o_custkey").alias("bundle_id"), k.alias("pos"), picked("o_orderkey", _ROUND_TYPES).alias("round_type"), targets.alias("target_question_ids"), each(_split(picked("o_orderkey", _STRATEGIES))).alias("strategy_types"), each(_split(picked("o_orderkey", _CHECKS))).alias("checks_completed"), each(_split(picked("o_orderkey", _OBJECTS))).alias("objects_checked"), each(strings()).alias("dimensions_checked"), each(picked("half", _IMPACTS)).alias("conclusion_impact"))
    out = research.coverage_diagnostics(b, q, s, rounds)
    lists = ("missing_source_kinds", "missing_checks", "missing_objects")
    return out.withColumns({x: F.array_join(x, ",") for x in lists}).drop("missing_dimensions")
