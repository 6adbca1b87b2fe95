"""Roll-ups: issues, deduplication, dashboards, probe summaries, gates, coverage, findings and repair plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import small

#: How bad a status or severity is.
RANKS = {"skipped": 0, "ok": 0, "pass": 0, "warn": 1, "partial": 2, "blocking": 2, "fail": 2}
SEVERITIES = ("high", "medium", "low")


def rank(c: Column, ranks: dict[str, int] = RANKS) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), c), F.lit(0))


def issue_rollup(issues: DataFrame, by: list[str]) -> DataFrame:
    """Issues by severity and a status: a high one fails, a medium one warns."""
    out = issues.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return out.withColumn("status", F.when(F.col("high") > 0, "fail").when(F.col("medium") > 0, "warn").otherwise("pass"))


def affected(issues: DataFrame, key: str = "block_id") -> DataFrame:
    kept = issues.where(F.col("severity").isin("high", "medium"))
    return kept.groupBy(key).agg(F.array_sort(F.collect_set("repair")).alias("repairs"), F.array_sort(F.collect_list(F.struct("severity", "title"))).alias("issues"))


def keep_first(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def keep_worst(rows: DataFrame, keys: list[str], severity: str, order: list[str | Column], types: str, first_types: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: the worst, then of a preferred type, then the first; with all types seen.

    The types are gathered by an aggregate, and the row is picked by ``max_by``, so a frequent key needs no sort.
    """
    preferred = F.col(types).isin(*first_types) if first_types else F.lit(False)
    worth = F.struct(rank(F.col(severity)).alias("a"), preferred.alias("b"), *[(-F.col(o) if isinstance(o, str) else -o).alias(f"o{i}") for i, o in enumerate(order)])
    rest = [c for c in rows.columns if c not in keys]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), worth).alias("_w"), F.array_sort(F.collect_set(types)).alias("all_types"))
    return out.select(*keys, *[F.col(f"_w.{c}").alias(c) for c in rest], "all_types")


PROBE_FLAGS = ("same_as_input", "non_chinese", "partial_untranslated", "placeholder_break", "style_tag_break", "protected_span_break", "task_explanation", "protected_mistranslation", "ordinary_failure")


def probe_summary(results: DataFrame, by: list[str], flags: tuple[str, ...] = PROBE_FLAGS, expected: str = "expected_behavior") -> DataFrame:
    """Counts and rates per group: over translate, protect or all rows, whichever the flag is about."""
    translate = F.col(expected) == "translate"
    out = results.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(translate).alias("translate_total"), F.count_if(~F.coalesce(translate, F.lit(False))).alias("protect_total"), *[F.count_if(F.col(f)).alias(f) for f in flags])
    over = {"placeholder_break": "total", "style_tag_break": "total", "protected_span_break": "total", "protected_mistranslation": "protect_total"}
    for f in flags:
        if f != "ordinary_failure":
            out = out.withColumn(f"{f}_rate", F.round(F.col(f) / F.greatest(F.lit(1), F.col(over.get(f, "translate_total"))), 4))
    if {"same_as_input", "non_chinese", "placeholder_break", "protected_mistranslation"} <= set(flags):
        out = out.withColumn("meets_thresholds", (F.col("same_as_input_rate") <= 0.02) & (F.col("non_chinese_rate") <= 0.02) & (F.col("placeholder_break_rate") <= 0.01) & (F.col("protected_mistranslation_rate") == 0))
    return out


def classify_probe(cases: DataFrame) -> DataFrame:
    """Adds the nine flags to cases (source, output, expected_behavior)."""
    s, o, e = F.col("source"), F.col("output"), F.col("expected_behavior")
    tokens = F.array_distinct(F.regexp_extract_all(T.text(s), F.lit(r"(\{v\d+\}|</?style\b[^>]*>|https?://[^\s<>]+|10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)"), 1))
    lost = F.filter(tokens, lambda t: ~T.text(o).contains(t))
    same, part, talk = T.same_as_input(s, o), T.partially_untranslated(s, o), T.task_explanation(o)
    non = (e == "translate") & T.needs_translation(s) & ~T.has_cjk(o) & T.visible(o).rlike("[A-Za-z]{4,}")
    out = cases.withColumn("missing_tokens", lost)
    return out.withColumns(
        {
            "same_as_input": same & (e == "translate"),
            "non_chinese": non,
            "partial_untranslated": part & (e == "translate"),
            "placeholder_break": F.exists("missing_tokens", lambda t: t.rlike(r"^\{v\d+\}$")),
            "style_tag_break": F.exists("missing_tokens", lambda t: t.rlike("(?i)^</?style")),
            "protected_span_break": F.size("missing_tokens") > 0,
            "task_explanation": talk,
            "protected_mistranslation": (e == "protect") & ~same & (T.visible(s) != T.visible(o)),
            "ordinary_failure": (e == "translate") & (same | non | part | talk),
        }
    )


def ledger_status(source: Column, output: Column) -> Column:
    lost = F.exists(F.regexp_extract_all(T.text(source), F.lit(r"(https?://[^\s<>]+|\{v\d+\})"), 1), lambda t: ~T.text(output).contains(t))
    return (
        F.when(T.text(output) == "", "empty_output")
        .when(T.passthrough_only(source) & (T.normalize(source) == T.normalize(output)), "protected_passthrough")
        .when(T.same_as_input(source, output), "same_as_input_or_non_chinese")
        .when(T.partially_untranslated(source, output), "partial_untranslated")
        .when(T.task_explanation(output), "task_explanation")
        .when(lost, "protected_value_missing")
        .otherwise("translated")
    )


def backend_quality(logs: DataFrame, id_col: str = "run_id", text_col: str = "log") -> DataFrame:
    """Counts taken from free-text logs, and a status by the share of paragraphs that fell back."""
    c = T.text(text_col)

    def first(p: str) -> Column:
        return F.coalesce(F.regexp_extract(c, p, 1).try_cast("int"), F.lit(0))

    out = logs.select(F.col(id_col), first(r"(?i)total paragraphs?\s*[:=]\s*(\d+)").alias("paragraphs"), F.regexp_count(c, F.lit("(?i)fallback to simple")).alias("fallbacks"), F.regexp_count(c, F.lit("(?i)json.{0,20}(?:error|invalid)")).alias("json_errors"), F.regexp_count(c, F.lit("(?i)same as input")).alias("same"), F.regexp_count(c, F.lit("(?i)cache hit")).alias("cache_hits"), F.regexp_count(c, F.lit("(?i)api call")).alias("calls"))
    ratio = F.col("fallbacks") / F.greatest(F.lit(1), F.col("paragraphs"))
    status = F.when((ratio >= 0.15) | (F.col("json_errors") >= 3) | (F.col("same") >= 3), "partial").when((ratio > 0.05) | (F.col("fallbacks") + F.col("json_errors") + F.col("same") > 0), "warn").otherwise("ok")
    return out.withColumn("fallback_ratio", F.round(ratio, 4)).withColumn("hit_ratio", F.round(F.col("cache_hits") / F.greatest(F.lit(1), F.col("calls")), 4)).withColumn("status", status)


def gate_rollup(gates: DataFrame, by: list[str], strict: bool = False) -> DataFrame:
    """Worst status of a group's gates, and how many of each; blocking (or, if strict, warn) makes it partial."""
    out = gates.groupBy(*by).agg(F.count("*").alias("n_gates"), F.count_if(F.col("status") == "blocking").alias("n_blocking"), F.count_if(F.col("status") == "warn").alias("n_warn"), F.max(rank(F.col("status"))).alias("_worst"))
    worst = F.when(F.col("_worst") >= 2, "blocking").when(F.col("_worst") == 1, "warn").otherwise("ok")
    bad = (F.col("_worst") >= 2) | ((F.col("_worst") >= 1) & F.lit(strict))
    return out.withColumn("worst", worst).withColumn("delivery", F.when(bad, "partial").otherwise("delivered")).drop("_worst")


def escalate(findings: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    return findings.withColumn("severity", F.when(F.col("rule").isin(*rules) & (F.col("severity") == "warn"), "blocking").otherwise(F.col("severity")))


def append_new(have: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    return have.unionByName(more.join(have.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def having_pages(lines: DataFrame, per_page: int = 6, most: int = 80, least_lines: int = 4, least_words: int = 40, least_cjk: int = 20) -> DataFrame:
    """English lines left on translated pages before the references: pages must show enough of them among enough CJK."""
    refs = lines.where(F.lower(F.trim("text")).isin("references", "bibliography", "参考文献")).groupBy("doc_id").agg(F.min("page").alias("_ref"))
    body = lines.join(refs, "doc_id", "left").where("_ref is null or page < _ref").drop("_ref")
    english = T.ordinary_english(F.col("text")) & ~T.has_cjk(F.col("text")) & ~T.protected_visible(F.col("text"))
    marked = body.withColumn("english", english).withColumn("words", F.size(T.ascii_words(F.col("text"), 4))).withColumn("cjk", T.cjk_count(F.col("text")))
    pages = marked.groupBy("doc_id", "page").agg(F.count_if("english").alias("l"), F.sum(F.when(F.col("english"), F.col("words")).otherwise(0)).alias("w"), F.sum("cjk").alias("c"))
    kept = pages.where(((F.col("l") >= least_lines) | (F.col("w") >= least_words)) & (F.col("c") >= least_cjk)).select("doc_id", "page")
    hits = marked.where("english").join(kept, ["doc_id", "page"])
    own = hits.withColumn("_n", F.row_number().over(W.partitionBy("doc_id", "page").orderBy("line_index"))).where(F.col("_n") <= per_page)
    return own.withColumn("_m", F.row_number().over(W.partitionBy("doc_id").orderBy("page", "line_index"))).where(F.col("_m") <= most).select("doc_id", "page", "line_index", "text")


def residue_audit(streams: list[DataFrame], critical_pages: tuple[int, ...] = (1,), body_roles: tuple[str, ...] = ("body_prose", "plain text", "text", "paragraph_hybrid", "unknown_visible_line", "")) -> DataFrame:
    """Findings of all streams, once each, without protected text, marked critical and blocking."""
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)
    once = keep_first(all_.where(~T.protected_visible(F.col("visible_text"))), ["doc_id", "failure_type", "page", "visible_text"], ["rule"])
    critical = F.coalesce(F.col("page").isin(*critical_pages), F.lit(False))
    blocking = (F.col("severity") == "blocking") | (critical & F.lower(T.text("layout_role")).isin(*body_roles)) | (F.col("failure_type") == "prompt_leak")
    return once.withColumn("critical_page", critical).withColumn("delivery_blocking", blocking)


def page_coverage(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """Pages 1..n without text: share, missing pages and a status, fail below half."""
    have = pages.groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("have"))
    out = totals.join(have, "doc_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<int>")))
    out = out.withColumn("missing_pages", F.array_except(F.when(F.col("n_pages") > 0, F.sequence(F.lit(1), F.col("n_pages").cast("int"))).otherwise(F.array().cast("array<int>")), F.col("have").cast("array<int>")))
    seen = F.col("n_pages") - F.size("missing_pages")
    return out.withColumn("coverage", F.round(seen / F.greatest(F.lit(1), F.col("n_pages")), 3)).withColumn("status", F.when(seen * 2 < F.col("n_pages"), "fail").when(F.size("missing_pages") > 0, "warn").otherwise("ok"))


def segment_gate(segments: DataFrame) -> DataFrame:
    """Per segment (segment_id, source, target): lost commands, unbalanced braces, and too little text."""
    commands = lambda c: F.regexp_extract_all(T.text(c), F.lit(r"(\\[A-Za-z]+)"), 1)
    letters, words = F.regexp_count(T.text("source"), F.lit("[A-Za-z]")), F.size(T.ascii_words(F.col("source"), 2))
    count = lambda c, x: F.size(F.filter(c, lambda y: y == x))
    lost = F.filter(F.array_distinct(commands("source")), lambda x: count(commands("source"), x) > count(commands("target"), x))
    braces = F.regexp_count(T.text("target"), F.lit(r"(?<!\\)\{")) != F.regexp_count(T.text("target"), F.lit(r"(?<!\\)\}"))
    short = (letters >= 600) & (words >= 90) & (F.length(T.text("target")) < F.greatest(F.lit(80.0), 0.22 * words))
    out = segments.select("segment_id", lost.alias("lost_commands"), braces.alias("unbalanced"), short.alias("incomplete"))
    return out.withColumn("status", F.when(F.col("unbalanced") | F.col("incomplete"), "blocking").when(F.size("lost_commands") > 0, "warn").otherwise("ok"))


def content_loss(segments: DataFrame) -> DataFrame:
    links = lambda c: F.array_distinct(F.regexp_extract_all(T.text(c), F.lit(r"(https?://[^\s{}]+|10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)"), 1))
    return segments.select("segment_id", (F.trim(T.text("target")) == "").alias("empty"), F.array_except(links("source"), links("target")).alias("missing_links"))


def dashboard(records: DataFrame, by: list[str]) -> DataFrame:
    out = records.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("completed")).alias("completed"))
    return out.withColumn("active", F.col("total") - F.col("completed")).withColumn("percentage", F.round(100 * F.col("completed") / F.greatest(F.lit(1), F.col("total"))).cast("long"))


def badges(counters: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (badge, counter, least) that a user's counters (user_id, counter, value) reach, once each."""
    return counters.join(small(rules), "counter").where(F.col("value") >= F.col("least")).select("user_id", "badge").distinct()


def key_texts_missing(source: DataFrame, target: DataFrame, limit: int = 12) -> DataFrame:
    """Years and upper-case lines of the first three source pages that the target's text lacks."""
    early = source.where("page <= 3")
    years = early.select("doc_id", "page", F.explode(F.regexp_extract_all(T.text("text"), F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), 1)).alias("key"))
    upper = early.where((F.col("text") == F.upper("text")) & F.col("text").rlike("[A-Z]{3,}")).select("doc_id", "page", F.trim("text").alias("key"))
    keys = years.unionByName(upper).groupBy("doc_id", "key").agg(F.min("page").alias("page"))
    keys = keys.withColumn("_n", F.row_number().over(W.partitionBy("doc_id").orderBy("page", "key"))).where(F.col("_n") <= limit)
    whole = target.groupBy(F.col("doc_id").alias("_d")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("page", "text")))["text"], "\n").alias("_all"))
    return keys.join(whole, F.col("doc_id") == F.col("_d"), "left").where(~T.text("_all").contains(F.col("key"))).select("doc_id", "key", "page")


def toc_preserved(source: DataFrame, target: DataFrame) -> DataFrame:
    """Contents pages that lost over half of their lines or whose numbers no longer ascend."""
    def of(df: DataFrame, p: str) -> DataFrame:
        n = F.regexp_extract(T.text("text"), r"(\d{1,3})\s*$", 1)
        g = df.withColumn("_n", F.when(n != "", n.cast("int"))).groupBy("doc_id", "page").agg(F.count("*").alias(f"{p}_lines"), F.array_sort(F.collect_list(F.when(F.col("_n").isNotNull(), F.struct("line_index", F.col("_n").alias("n"))))).alias("b"))
        return g.select("doc_id", "page", f"{p}_lines", F.transform("b", lambda x: x["n"]).alias(f"{p}_numbers"))

    met = of(source, "s").join(of(target, "t"), ["doc_id", "page"], "left")
    dropped = (F.coalesce("t_lines", F.lit(0)) * 2 < F.col("s_lines")) | (F.size(F.coalesce("t_numbers", F.array().cast("array<int>"))) * 2 < F.size("s_numbers"))
    return met.withColumn("dropped", dropped).withColumn("unsorted", F.coalesce(F.col("t_numbers") != F.array_sort("t_numbers"), F.lit(False)))


def names_lost(source: DataFrame, target: DataFrame, least: int = 8, share: float = 0.24) -> DataFrame:
    s = source.select("doc_id", "page", T.person_names(F.col("text")).alias("names"))
    t = target.select("doc_id", "page", F.col("text").alias("_t"))
    met = s.join(t, ["doc_id", "page"]).withColumn("lost", F.filter("names", lambda n: ~F.col("_t").contains(n)))
    return met.where((F.size("names") >= least) & (F.size("lost") >= share * F.size("names"))).select("doc_id", "page", "names", "lost")


def document_coverage(source: DataFrame, target: DataFrame) -> DataFrame:
    """Pages that came out blank or thin next to their source."""
    met = source.select("doc_id", "page", F.length(T.text("text")).alias("s")).join(target.select("doc_id", "page", F.length(T.text("text")).alias("t"), T.cjk_count(F.col("text")).alias("cjk")), ["doc_id", "page"], "left")
    low = (F.col("s") >= 20) & (F.coalesce("t", F.lit(0)) < F.greatest(F.lit(20.0), 0.08 * F.col("s"))) & (F.coalesce("cjk", F.lit(0)) < 8)
    return met.withColumn("status", F.when(F.coalesce("t", F.lit(0)) == 0, "blank").when(low, "low").otherwise("ok"))


def repair_plan(findings: DataFrame, targets: dict[str, str]) -> DataFrame:
    """One numbered task for each finding, with the target its failure type maps to."""
    to = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]), F.col("failure_type")), F.lit("manual_review"))
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "failure_type", "visible_text"))
    return findings.select("doc_id", F.format_string("repair-%04d", n).alias("task_id"), "page", "failure_type", to.alias("repair_target"))


def rerender_tasks(affected_blocks: DataFrame) -> DataFrame:
    """Issues of blocks as tasks with the narrowest scope known, once each."""
    e = affected_blocks.select("block_id", "engine_block_id", "page", F.explode("issues").alias("i")).select("*", "i.*").drop("i")
    scope = F.when(F.col("engine_block_id").isNotNull(), "engine_block").when(F.col("page").isNotNull(), "page").otherwise("full_document")
    return e.withColumn("scope", scope).dropDuplicates(["block_id", "title", "scope"])


def qa_checks(issues: DataFrame) -> DataFrame:
    repair = F.when(F.col("rule").rlike("protect"), "restore_protected").when(F.col("rule").rlike("term|policy"), "apply_policy").when(F.col("rule").rlike("residue|english"), "translate_rest").otherwise("review")
    return issues.where(F.col("severity").isin("high", "medium")).withColumn("repair", repair)


def override(rows: DataFrame, overrides: DataFrame, keys: list[str], field: str) -> DataFrame:
    """``field`` replaced by the first override (by pos) of the same key, if it qualifies."""
    first = overrides.groupBy(*keys).agg(F.min_by("value", "pos").alias("_v"))
    return rows.join(first, keys, "left").withColumn(field, F.coalesce("_v", field)).drop("_v")


def case_warnings(cases: DataFrame, least: int = 20, kinds: tuple[str, ...] = ("real_translate", "translate", "protect")) -> DataFrame:
    spark = cases.sparkSession
    want = spark.createDataFrame([(k,) for k in kinds], "kind string")
    have = cases.groupBy("kind").count().withColumnRenamed("kind", "_k")
    return want.join(have, F.col("kind") == F.col("_k"), "left").select("kind", F.coalesce("count", F.lit(0)).alias("n")).where(F.col("n") < least)


def select_cases(cases: DataFrame, most: int, order: str = "pos") -> DataFrame:
    real = F.col("origin").rlike("backend_retry_failures|translation_proxy_stats")
    bucket = F.concat(F.when(real, "real_").otherwise(""), F.coalesce("expected_behavior", F.lit("translate")))
    out = cases.withColumn("bucket", bucket)
    return out.withColumn("_n", F.row_number().over(W.partitionBy("bucket").orderBy(order))).where(F.col("_n") <= most).drop("_n")


def expected_behavior(source: Column, classification: Column, role: Column) -> Column:
    kept = T.text(classification).isin("protected_or_passthrough", "layout_role_passthrough", "already_translated_passthrough")
    roles = T.text(role).isin("doi_line", "author_line", "reference_item", "url_line", "page_number")
    return F.when(T.passthrough_only(source) | kept | roles, "protect").otherwise("translate")


def passthrough_class(c: Column, role: Column) -> Column:
    return (
        F.when(F.length(T.collapse(c)) <= 2, "cover_split_fragment")
        .when(T.text(role).isin("doi_line", "author_line", "reference_item", "url_line", "page_number"), "layout_role_passthrough")
        .when(T.has_cjk(c) & ~T.ordinary_english(c), "already_translated_passthrough")
        .when(T.passthrough_only(c), "protected_or_passthrough")
        .otherwise("ordinary_same_as_input")
    )


def failure_stage(log: Column) -> Column:
    """Words of a log, tried in this order, and the stage they tell of."""
    out = F.lit("missing_output")
    for words, stage in reversed(((r"no module named|not found: tool", "dependency"), (r"glossary.*(?:api|request)", "glossary_api"), (r"translat\w*.*(?:timeout|api)", "translation_api"), (r"api (?:error|key)|\b401\b|\b429\b", "api"), (r"latexmk|pdflatex|undefined control sequence", "compile"), (r"exit (?:code|status) [1-9]", "process_exit"))):
        out = F.when(F.lower(T.text(log)).rlike(words), stage).otherwise(out)
    return out


def layout_role(c: Column, label: Column, references_mode: Column) -> Column:
    """Role of a visible line by ordered rules."""
    s, low = T.collapse(c), T.normalize(c)
    rules = (
        (s == "", "empty"),
        (s.rlike(r"^\d{1,4}$"), "page_number"),
        (s.rlike(r"(?i)^(?:https?://\S+|www\.\S+)$"), "url_line"),
        (s.rlike(r"(?i)^(?:doi\s*[:.]?\s*)?(?:https?://doi\.org/)?10\.\d{4,9}/\S+$"), "doi_line"),
        (s.rlike(r"^\S+@\S+\.\S+$"), "email_line"),
        (s.rlike(r"(?i)^arxiv\s*:"), "arxiv_stamp"),
        (low.rlike(r"^(?:\d+\.?\s*)?(?:references|bibliography)$"), "references_heading"),
        (references_mode & s.rlike(r"(?:19|20)\d{2}"), "reference_item"),
        (s.rlike(r"(?i)^(?:figure|fig\.)\s*\d+"), "figure_caption"),
        (s.rlike(r"(?i)^table\s*\d+"), "table_caption"),
        (low.rlike(r"^(?:\d+(?:\.\d+)*\.?\s+)?(?:abstract|introduction|related work|methods?|methodology|experiments?|results|discussion|conclusions?)$"), "section_heading"),
        (s.rlike(r"\.{4,}\s*\d+$"), "toc_row"),
        (s.rlike(r"^(?:[-•*]|\(?\d{1,2}[.)])\s+\S"), "list_item"),
        (s.rlike(r"^\$|\\begin\{(?:equation|align)"), "equation"),
        (T.protected_visible(c), "protected_line"),
        (F.size(F.split(s, " ")) >= 10, "body_prose"),
        (T.text(label) != "", "labelled"),
    )
    out = F.when(rules[0][0], rules[0][1])
    for test, name in rules[1:]:
        out = out.when(F.coalesce(test, F.lit(False)), name)
    return out.otherwise("unknown_visible_line")


def normalize_finding(findings: DataFrame) -> DataFrame:
    """Severity words mapped to three, and stage and cause told from the message by ordered keywords."""
    s, m = F.lower(T.text("severity")), F.lower(T.text("message"))
    severity = F.when(s.isin("blocking", "critical", "error", "high", "p0"), "blocking").when(s.isin("warn", "warning", "medium", "p1"), "warn").otherwise("info")
    stage = F.when(m.rlike("font|size|overlap|layout|position"), "layout").when(m.rlike("translat|residue|english"), "translation").when(m.rlike("missing|dropped|blank"), "writeback").otherwise("unknown")
    said = [F.regexp_extract(T.text("message"), p, 1).try_cast("int") for p in (r"第\s*(\d+)\s*页", r"p\.\s*(\d+)")]
    page = F.coalesce(F.col("page").cast("int"), *said)
    return findings.withColumn("severity", severity).withColumn("stage", stage).withColumn("page", page)
