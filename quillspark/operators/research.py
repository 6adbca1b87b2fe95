"""Validation of research records: references, claims, rounds, coverage, stop decision, review, and status.

Tables carry ``bundle_id``; findings are rows ``bundle_id, code, args``. Checks are filters, anti joins and aggregates,
unioned; nothing is looped over on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The vocabularies of a research record.
QUESTION_STATUSES = ("answered", "partially_answered", "unanswered", "unsupported")
SOURCE_KINDS = ("official_document", "scholarly_research", "independent_evaluation", "industry_analysis", "user_or_adoption_evidence", "journalism", "other")
STAKEHOLDER_RELATIONS = ("first_party", "independent", "interested_third_party", "user_provided", "unknown")
ACCESS_STATUSES = ("full_text", "substantive_sections", "metadata_only", "unavailable")
SUPPORTING_ACCESS = ("full_text", "substantive_sections")
SOURCE_ORIGINS = ("host_opened_page", "downloaded_document", "user_provided_material")
COVERAGE_CHECKS = ("freshness", "counterevidence", "omitted_objects", "omitted_dimensions")
CLAIM_TYPES = ("current_fact", "quantitative", "comparative", "recommendation", "risk", "adoption", "background")
INDEPENDENT_CLAIMS = ("comparative", "recommendation", "risk", "adoption")
ROUND_TYPES = ("main_research", "coverage_gap_check", "adversarial_saturation_check")
STRATEGIES = ("primary_sources", "independent_validation", "counterevidence", "freshness", "omission_scan", "user_material")
ADVERSARIAL = ("independent_validation", "counterevidence", "freshness", "omission_scan")
IMPACTS = ("changed", "strengthened", "narrowed", "none")
REPORT_SECTIONS = ("executive_summary", "scope_and_method", "limitations", "sources")
REPORT_LEAST, SECTION_LEAST = 100, 40
STATUS_MAP = (("complete", "not_reviewed", "complete_draft"), ("complete", "pass", "reviewed_pass"), ("complete", "fail", "reviewed_fail"), ("partial", "not_reviewed", "partial"), ("partial", "fail", "partial"), ("blocked", "not_reviewed", "blocked"), ("blocked", "fail", "blocked"))
REFERENCE = r"\[([A-Z][A-Z0-9_-]*)\](?!\()"


def finding(rows: DataFrame, code: str, *args: str) -> DataFrame:
    return rows.select("bundle_id", F.lit(code).alias("code"), F.array(*[F.col(a).cast("string") for a in args]).cast("array<string>").alias("args"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def blank(c: str) -> Column:
    return F.trim(T.text(c)) == ""


def duplicate_ids(rows: DataFrame, id_col: str, code: str) -> DataFrame:
    return finding(rows.where(~blank(id_col)).groupBy("bundle_id", id_col).count().where("count > 1"), code, id_col)


def outside(rows: DataFrame, col: str, allowed: tuple[str, ...], code: str, id_col: str) -> DataFrame:
    return finding(rows.where(~F.coalesce(F.col(col).isin(*allowed), F.lit(False))), code, id_col)


def unknown_refs(rows: DataFrame, array_col: str, id_col: str, known: DataFrame, known_col: str, code: str) -> DataFrame:
    refs = rows.select("bundle_id", id_col, F.explode(array_col).alias("_ref"))
    ids = known.select(F.col("bundle_id").alias("_b"), F.col(known_col).alias("_k"))
    return finding(refs.join(ids, (F.col("bundle_id") == F.col("_b")) & (F.col("_ref") == F.col("_k")), "left_anti"), code, id_col, "_ref")


def string_lists(rows: DataFrame, col: str, id_col: str, key: str, allowed: tuple[str, ...] | None = None, nonempty: bool = False) -> DataFrame:
    """Findings on a list column: missing or blank items, duplicates, emptiness, values that aren't allowed."""
    items = F.transform(F.coalesce(F.col(col), F.array().cast("array<string>")), lambda x: F.trim(x))  # F.trim itself would take the place as its second argument
    bad = F.col(col).isNull() | F.exists(F.coalesce(F.col(col), F.array().cast("array<string>")), lambda x: x.isNull() | (F.trim(x) == ""))
    good = rows.where(~bad).withColumn("_items", items)
    parts = [finding(rows.where(bad), key, id_col), finding(good.where(F.size("_items") != F.size(F.array_distinct("_items"))), f"{key}_duplicate", id_col)]
    if nonempty:
        parts.append(finding(good.where(F.size("_items") == 0), f"{key}_empty", id_col))
    if allowed is not None:
        parts.append(finding(good.select("bundle_id", id_col, F.explode("_items").alias("_x")).where(~F.col("_x").isin(*allowed)), f"{key}_invalid", id_col, "_x"))
    return union(parts)


def map_keys_match(rows: DataFrame, map_col: str, targets_col: str, id_col: str, key: str) -> DataFrame:
    """Findings where a map's keys aren't exactly a round's target questions."""
    keys = F.coalesce(F.map_keys(map_col), F.array().cast("array<string>"))
    extra = rows.select("bundle_id", id_col, F.explode(F.array_except(keys, targets_col)).alias("_q"))
    lacking = rows.select("bundle_id", id_col, F.explode(F.array_except(targets_col, keys)).alias("_q"))
    return union([finding(extra, f"{key}_unknown_question", id_col, "_q"), finding(lacking, f"{key}_missing_question", id_col, "_q")])


def check_questions(bundles: DataFrame, questions: DataFrame) -> DataFrame:
    q = questions.join(bundles.select("bundle_id", "research_status", "report"), "bundle_id")
    heading = F.trim(T.text("answer_section"))
    shown = F.exists(F.split("report", "\n"), lambda x: F.trim(x) == heading) & heading.rlike(r"^#{1,6}\s+.+$")
    answers = F.col("status").isin("answered", "partially_answered", "unsupported")
    open_partial = (F.col("research_status") == "partial") & (F.col("status") != "answered")
    uses = questions.where(~blank("answer_section") & F.col("status").isin("answered", "partially_answered", "unsupported")).groupBy("bundle_id", F.trim("answer_section").alias("_h")).agg(F.array_sort(F.collect_list(F.struct("pos", "question_id"))).alias("_u")).where(F.size("_u") > 1)
    clash = uses.select("bundle_id", F.col("_u")[0]["question_id"].alias("_first"), F.explode(F.slice("_u", 2, 1 << 20)).alias("_o")).select("bundle_id", "_first", F.col("_o.question_id").alias("_other"))
    none_open = q.where("research_status = 'partial'").groupBy("bundle_id").agg(F.min((F.col("status") == "answered").cast("int")).alias("m")).where("m = 1")
    return union(
        [
            finding(bundles.join(questions, "bundle_id", "left_anti"), "questions_missing"),
            finding(q.where(blank("question_id")), "question_id_missing", "pos"),
            duplicate_ids(questions, "question_id", "duplicate_question_id"),
            finding(q.where(blank("question")), "question_text_missing", "question_id"),
            outside(q, "status", QUESTION_STATUSES, "question_status_invalid", "question_id"),
            finding(q.where((F.col("research_status") == "complete") & (F.col("status") != "answered")), "complete_question_not_answered", "question_id"),
            finding(q.where((answers | (heading != "")) & ~shown), "question_answer_section_missing", "question_id"),
            finding(clash, "question_answer_section_not_unique", "_first", "_other"),
            finding(q.where(open_partial & blank("current_evidence")), "partial_question_current_evidence_missing", "question_id"),
            finding(q.where(open_partial & blank("next_step")), "partial_question_next_step_missing", "question_id"),
            finding(none_open, "partial_has_no_open_question"),
            string_lists(questions, "required_source_kinds", "question_id", "question_required_source_kinds", SOURCE_KINDS, True),
            string_lists(questions, "required_checks", "question_id", "question_required_checks", COVERAGE_CHECKS, True),
        ]
    )


def check_sources(bundles: DataFrame, questions: DataFrame, sources: DataFrame) -> DataFrame:
    url = sources.withColumn("_url", T.canonical_url(F.col("url")))
    first = url.where("_url is not null").groupBy("bundle_id", "_url").agg(F.min_by("source_id", "pos").alias("_first"), F.min("pos").alias("_p"))
    again = url.join(first, ["bundle_id", "_url"]).where(F.col("pos") > F.col("_p"))
    complete = bundles.where("research_status = 'complete'")
    return union(
        [
            finding(sources.where(blank("source_id")), "source_id_missing", "pos"),
            finding(sources.where(~blank("source_id") & ~F.col("source_id").rlike(r"^[A-Z][A-Z0-9_-]*$")), "source_id_invalid", "source_id"),
            duplicate_ids(sources, "source_id", "duplicate_source_id"),
            *[finding(sources.where(blank(c)), f"source_{c}_missing", "source_id") for c in ("title", "publisher", "url", "accessed_at")],
            outside(sources, "access_status", ACCESS_STATUSES, "source_access_status_invalid", "source_id"),
            outside(sources, "content_origin", SOURCE_ORIGINS, "source_content_origin_invalid", "source_id"),
            outside(sources, "source_kind", SOURCE_KINDS, "source_kind_invalid", "source_id"),
            outside(sources, "stakeholder_relation", STAKEHOLDER_RELATIONS, "source_stakeholder_relation_invalid", "source_id"),
            finding(sources.where(~blank("accessed_at") & ~T.valid_iso(F.col("accessed_at"))), "source_accessed_at_invalid", "source_id"),
            finding(sources.where(~blank("published_at") & ~T.valid_iso(F.col("published_at"))), "source_published_at_invalid", "source_id"),
            unknown_refs(sources, "question_ids", "source_id", questions, "question_id", "source_unknown_question"),
            finding(again, "duplicate_source_url", "_first", "source_id"),
            finding(complete.join(sources, "bundle_id", "left_anti"), "complete_sources_missing"),
        ]
    )


def citations(bundles: DataFrame) -> DataFrame:
    return bundles.select("bundle_id", F.explode(F.array_distinct(F.regexp_extract_all("report", F.lit(REFERENCE), 1))).alias("cited"))


def check_citations(bundles: DataFrame, questions: DataFrame, sources: DataFrame, claims: DataFrame) -> DataFrame:
    cited = citations(bundles)
    known = sources.select("bundle_id", F.col("source_id").alias("cited")).union(questions.select("bundle_id", "question_id")).union(claims.select("bundle_id", "claim_id"))
    of_sources = cited.join(sources.select("bundle_id", F.col("source_id").alias("cited")), ["bundle_id", "cited"], "left_semi")
    silent = bundles.where("research_status = 'complete'").join(of_sources, "bundle_id", "left_anti")
    return union([finding(cited.join(known, ["bundle_id", "cited"], "left_anti"), "unknown_report_citation", "cited"), finding(silent, "complete_report_has_no_source_citations")])


def namespace_collisions(questions: DataFrame, sources: DataFrame, claims: DataFrame) -> DataFrame:
    ids = questions.select("bundle_id", F.col("question_id").alias("id"), F.lit("question").alias("k")).union(sources.select("bundle_id", "source_id", F.lit("source"))).union(claims.select("bundle_id", "claim_id", F.lit("claim")))
    return finding(ids.groupBy("bundle_id", "id").agg(F.count_distinct("k").alias("n")).where("n > 1"), "identifier_namespace_collision", "id")


def evidence_units(bundles: DataFrame) -> DataFrame:
    """``bundle_id, unit``: paragraphs, and each table row, of the report."""
    lines = bundles.select("bundle_id", F.posexplode(F.split("report", "\n")).alias("pos", "line"))
    from pyspark.sql import Window as W

    order = W.partitionBy("bundle_id").orderBy("pos")
    row = T.table_row(F.col("line"))
    lines = lines.withColumn("row", row).withColumn("blank", F.trim("line") == "")
    prose = ~F.col("row") & ~F.col("blank")
    before = F.lag(prose.cast("int"), 1, 0).over(order)
    lines = lines.withColumn("start", F.col("row") | (prose & (before == 0))).withColumn("island", F.sum(F.col("start").cast("int")).over(order)).where(~F.col("blank") & ~T.separator_row(F.col("line")))
    out = lines.groupBy("bundle_id", "island").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("b"))
    return out.select("bundle_id", F.trim(F.array_join(F.transform("b", lambda x: x["line"]), "\n")).alias("unit"))


def check_claims(bundles: DataFrame, questions: DataFrame, sources: DataFrame, claims: DataFrame) -> DataFrame:
    from .align import bound_claims

    bound = bound_claims(evidence_units(bundles), claims).where(~F.col("bound"))
    refs = claims.select("bundle_id", "claim_id", "claim_type", F.explode("source_ids").alias("source_id")).join(sources.select("bundle_id", "source_id", "access_status", "stakeholder_relation"), ["bundle_id", "source_id"])
    weak = refs.where(~F.col("access_status").isin(*SUPPORTING_ACCESS))
    independent = refs.groupBy("bundle_id", "claim_id", "claim_type").agg(F.max((F.col("stakeholder_relation") == "independent").cast("int")).alias("i")).where(F.col("claim_type").isin(*INDEPENDENT_CLAIMS) & (F.col("i") == 0))
    return union(
        [
            finding(claims.where(blank("claim_id")), "claim_id_missing", "pos"),
            duplicate_ids(claims, "claim_id", "duplicate_claim_id"),
            finding(claims.where(blank("claim")), "claim_text_missing", "claim_id"),
            outside(claims, "claim_type", CLAIM_TYPES, "claim_type_invalid", "claim_id"),
            unknown_refs(claims, "question_ids", "claim_id", questions, "question_id", "claim_unknown_question"),
            unknown_refs(claims, "source_ids", "claim_id", sources, "source_id", "claim_unknown_source"),
            finding(bound, "claim_source_not_cited_with_claim", "claim_id", "source_id"),
            finding(weak, "claim_source_not_substantive", "claim_id", "source_id"),
            finding(independent, "claim_independent_evidence_missing", "claim_id"),
        ]
    )


def round_targets(rounds: DataFrame) -> DataFrame:
    return rounds.select("*", F.explode("target_question_ids").alias("question_id"))


def check_rounds(bundles: DataFrame, questions: DataFrame, rounds: DataFrame) -> DataFrame:
    """Round vocabulary and references; for complete research, each question's main round precedes a gap check, which
    precedes a saturation check: some i < j < k exists if a gap round lies after the first main and before the last check."""
    complete = questions.join(bundles.where("research_status = 'complete'").select("bundle_id"), "bundle_id").select("bundle_id", "question_id")
    t = round_targets(rounds)
    kinds = t.groupBy("bundle_id", "question_id").agg(F.collect_set("round_type").alias("have"), F.min(F.when(F.col("round_type") == ROUND_TYPES[0], F.col("pos"))).alias("main"), F.max(F.when(F.col("round_type") == ROUND_TYPES[2], F.col("pos"))).alias("check"))
    met = complete.join(kinds, ["bundle_id", "question_id"], "left")
    lacking = met.select("bundle_id", "question_id", F.explode(F.array_except(F.array(*[F.lit(x) for x in ROUND_TYPES]), F.coalesce("have", F.array().cast("array<string>")))).alias("_t"))
    gaps = t.where(F.col("round_type") == ROUND_TYPES[1]).select("bundle_id", "question_id", F.col("pos").alias("gap"))
    ordered = met.join(gaps, ["bundle_id", "question_id"]).groupBy("bundle_id", "question_id").agg(F.max(((F.col("main") < F.col("gap")) & (F.col("gap") < F.col("check"))).cast("int")).alias("ok"), F.first("main").alias("main"), F.first("check").alias("check"))
    return union(
        [
            finding(rounds.where(blank("round_id")), "research_round_id_missing", "pos"),
            duplicate_ids(rounds, "round_id", "duplicate_research_round_id"),
            outside(rounds, "round_type", ROUND_TYPES, "research_round_type_invalid", "round_id"),
            unknown_refs(rounds, "target_question_ids", "round_id", questions, "question_id", "research_round_unknown_question"),
            *[map_keys_match(rounds, c, "target_question_ids", "round_id", f"research_round_{c}") for c in ("strategy_types", "checks_completed", "objects_checked", "dimensions_checked")],
            finding(lacking, "research_round_question_not_covered", "question_id", "_t"),
            finding(ordered.where("ok = 0 and main is not null and check is not null"), "research_round_order_invalid", "question_id"),
        ]
    )


def coverage_diagnostics(bundles: DataFrame, questions: DataFrame, sources: DataFrame, rounds: DataFrame) -> DataFrame:
    """Per question: what its requirements still lack, and how its last saturation check went."""
    none = F.array().cast("array<string>")
    cited = citations(bundles).select("bundle_id", F.col("cited").alias("source_id"))
    able = sources.where(F.col("access_status").isin(*SUPPORTING_ACCESS)).join(cited, ["bundle_id", "source_id"], "left_semi").select("bundle_id", F.explode("question_ids").alias("question_id"), "source_id", "source_kind", "stakeholder_relation")
    have = able.groupBy("bundle_id", "question_id").agg(F.collect_set("source_kind").alias("kinds"), F.max((F.col("stakeholder_relation") == "independent").cast("int")).alias("independent"))
    t = round_targets(rounds)
    at = lambda c: F.coalesce(F.element_at(c, F.col("question_id")), none)
    r = t.select("bundle_id", "question_id", "pos", "round_type", at("strategy_types").alias("strategies"), at("checks_completed").alias("checks"), at("objects_checked").alias("objects"), at("dimensions_checked").alias("dimensions"), F.element_at("conclusion_impact", F.col("question_id")).alias("impact"))
    sat = (F.col("round_type") == ROUND_TYPES[2]) & F.col("impact").isin(*IMPACTS)
    seen = r.groupBy("bundle_id", "question_id").agg(
        F.array_distinct(F.flatten(F.collect_list("objects"))).alias("objects"),
        F.array_distinct(F.flatten(F.collect_list("dimensions"))).alias("dimensions"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("round_type") == ROUND_TYPES[0], F.col("strategies"))))).alias("main_strategies"),
        F.max_by(F.struct("pos", "impact", "strategies", "checks"), F.when(sat, F.col("pos"))).alias("last"),
    )
    later = r.join(seen.select("bundle_id", "question_id", F.col("last.pos").alias("_p")), ["bundle_id", "question_id"]).where((F.col("pos") > F.col("_p")) & F.coalesce(F.col("impact") != "none", F.lit(True))).select("bundle_id", "question_id").distinct().withColumn("changed_later", F.lit(True))
    q = questions.join(have, ["bundle_id", "question_id"], "left").join(seen, ["bundle_id", "question_id"], "left").join(later, ["bundle_id", "question_id"], "left")
    lack = lambda need, got: F.array_sort(F.array_except(F.coalesce(need, none), F.coalesce(got, none)))
    return q.select(
        "bundle_id",
        "question_id",
        lack("required_source_kinds", "kinds").alias("missing_source_kinds"),
        (F.coalesce(F.col("independent_evidence_required"), F.lit(False)) & (F.coalesce("independent", F.lit(0)) == 0)).alias("independent_evidence_missing"),
        lack("required_checks", F.col("last.checks")).alias("missing_checks"),
        lack("required_objects", "objects").alias("missing_objects"),
        lack("required_dimensions", "dimensions").alias("missing_dimensions"),
        F.col("last.impact").alias("last_saturation_impact"),
        F.coalesce("changed_later", F.lit(False)).alias("changed_later"),
        F.arrays_overlap(F.coalesce(F.col("last.strategies"), none), F.array(*[F.lit(x) for x in ADVERSARIAL])).alias("adversarial"),
        (F.array_sort(F.coalesce(F.col("last.strategies"), none)) != F.array_sort(F.coalesce("main_strategies", none))).alias("distinct_strategy"),
    )


def check_coverage(bundles: DataFrame, diagnostics: DataFrame) -> DataFrame:
    d = diagnostics.join(bundles.where("research_status = 'complete'").select("bundle_id"), "bundle_id")
    parts = [finding(d.where(F.size(c) > 0).withColumn("_x", F.array_join(c, ",")), code, "question_id", "_x") for c, code in (("missing_source_kinds", "question_source_kinds_not_covered"), ("missing_checks", "question_checks_not_completed"), ("missing_objects", "question_objects_not_checked"), ("missing_dimensions", "question_dimensions_not_checked"))]
    return union(
        [
            *parts,
            finding(d.where("independent_evidence_missing"), "question_independent_evidence_missing", "question_id"),
            finding(d.where("coalesce(last_saturation_impact, '') <> 'none'").withColumn("_x", F.coalesce("last_saturation_impact", F.lit("missing"))), "question_not_saturated", "question_id", "_x"),
            finding(d.where("changed_later"), "question_changed_after_saturation", "question_id"),
            finding(d.where(~F.col("adversarial")), "question_saturation_strategy_not_adversarial", "question_id"),
            finding(d.where(~F.col("distinct_strategy")), "question_saturation_strategy_not_distinct", "question_id"),
        ]
    )


def check_report_sections(bundles: DataFrame) -> DataFrame:
    want = bundles.select("bundle_id", "report", "report_sections", F.explode(F.array(*[F.lit(s) for s in REPORT_SECTIONS])).alias("section"))
    want = want.withColumn("heading", F.trim(F.element_at("report_sections", F.col("section"))))
    shown = F.coalesce(F.exists(F.split("report", "\n"), lambda x: F.trim(x) == F.col("heading")), F.lit(False))
    same = want.where("heading is not null").groupBy("bundle_id").agg(F.count("*").alias("n"), F.count_distinct("heading").alias("m")).where("n <> m")
    short = bundles.where(T.substantive_length(F.col("report")) < REPORT_LEAST)
    return union([finding(want.where(~shown), "report_section_missing", "section"), finding(same, "report_sections_not_distinct"), finding(short, "report_too_short")])


def check_stop(declared: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Declared gaps (bundle_id, gap_type, question_id, item) against those derived: each side's surplus is a finding."""
    derived = union([diagnostics.select("bundle_id", F.lit(g).alias("gap_type"), "question_id", F.explode(c).alias("item")) for g, c in (("source_kind", "missing_source_kinds"), ("check", "missing_checks"), ("object", "missing_objects"), ("dimension", "missing_dimensions"))])
    cols = ["bundle_id", "gap_type", "question_id", "item"]
    over, under = declared.select(*cols).exceptAll(derived.select(*cols)), derived.select(*cols).exceptAll(declared.select(*cols))
    return union([finding(over, "stop_gap_not_derived", "gap_type", "question_id", "item"), finding(under, "stop_gap_not_declared", "gap_type", "question_id", "item")])


def check_review(reviews: DataFrame, review_items: DataFrame, expected: DataFrame, hashes: DataFrame, current: DataFrame) -> DataFrame:
    """Counts declared by a review (bundle_id, kind, n) against its items (bundle_id, kind, id, status); every expected
    (bundle_id, kind, id) covered once; file hashes equal."""
    made = review_items.groupBy("bundle_id", "kind").agg(F.count("*").alias("m"))
    counts = reviews.join(made, ["bundle_id", "kind"], "full_outer").where(F.coalesce("n", F.lit(0)) != F.coalesce("m", F.lit(0)))
    times = review_items.groupBy("bundle_id", "kind", "id").count()
    lacking = expected.join(times, ["bundle_id", "kind", "id"], "left_anti")
    moved = current.join(hashes.withColumnRenamed("sha256", "_was"), ["bundle_id", "file"], "left").where("not (sha256 <=> _was)")
    return union([finding(counts, "review_count_mismatch", "kind"), finding(lacking, "review_item_missing", "kind", "id"), finding(times.where("count > 1"), "review_item_duplicate", "kind", "id"), finding(moved, "review_candidate_hash_mismatch", "file")])


def delivery_status(bundles: DataFrame, review_status: DataFrame, findings: DataFrame) -> DataFrame:
    """``bundle_id, delivery_status, n_errors``: a lookup of research and review status; any finding makes it invalid."""
    met = bundles.select("bundle_id", "research_status").join(review_status, "bundle_id", "left").withColumn("r", F.coalesce("review_status", F.lit("not_reviewed")))
    n = findings.groupBy("bundle_id").agg(F.count("*").alias("n_errors"))
    status = F.lit("invalid")
    for research, review, name in STATUS_MAP:
        status = F.when((F.col("research_status") == research) & (F.col("r") == review), name).otherwise(status)
    return met.join(n, "bundle_id", "left").select("bundle_id", F.when(F.col("n_errors").isNull(), status).otherwise("invalid").alias("delivery_status"), F.coalesce("n_errors", F.lit(0)).cast("long").alias("n_errors"))


def validate(bundles: DataFrame, questions: DataFrame, sources: DataFrame, claims: DataFrame, rounds: DataFrame) -> DataFrame:
    """All findings of the record itself; the stop decision and the review have checks of their own."""
    diagnostics = coverage_diagnostics(bundles, questions, sources, rounds)
    return union([check_report_sections(bundles), check_questions(bundles, questions), check_sources(bundles, questions, sources), check_citations(bundles, questions, sources, claims), namespace_collisions(questions, sources, claims), check_claims(bundles, questions, sources, claims), check_rounds(bundles, questions, rounds), check_coverage(bundles, diagnostics)])
