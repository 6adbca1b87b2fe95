import random

import pytest
from pyspark.sql import functions as F

from quillspark import queries
from quillspark.operators import align, blocks, events, quality, research, routing, spans, spatial, terms

PAPER = "Title line\nmore title\n\n# Abstract\nWe use x_y at https://a.b/c. and `code`.\n<!-- page:2 -->\nHeader of the journal page\n```py\na = 1\n\nb\n```\nIntroduction\nbody $x$ [12] \\cite{k} 10.1234/ab.c\n<!-- page:3 -->\nHeader of the journal page\nlast"


@pytest.fixture(scope="module")
def paper(spark):
    return spark.createDataFrame([(1, PAPER), (2, ""), (3, None), (4, "one")], "doc_id long, text string")


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_blocks(paper):
    got = blocks.build_blocks(paper).where("doc_id = 1").orderBy("pos")
    assert rows(got, "block_id", "element_type", "page", "section", "text") == [
        ("block-0001", "paragraph", None, "", "Title line\nmore title"),
        ("block-0002", "heading", None, "Abstract", "# Abstract"),
        ("block-0003", "paragraph", None, "Abstract", "We use x_y at https://a.b/c. and `code`."),
        ("block-0004", "paragraph", 2, "Abstract", "Header of the journal page"),
        ("block-0005", "code", 2, "Abstract", "```py\na = 1\n\nb\n```"),
        ("block-0006", "heading", 2, "Introduction", "Introduction"),
        ("block-0007", "paragraph", 2, "Introduction", "body $x$ [12] \\cite{k} 10.1234/ab.c"),
        ("block-0008", "paragraph", 3, "Introduction", "Header of the journal page\nlast"),
    ]
    assert rows(blocks.build_blocks(paper).where("doc_id <> 1"), "doc_id", "text") == [(4, "one")]
    sec = blocks.sections(blocks.build_blocks(paper)).where("doc_id = 1 and section = 'Abstract'").first()
    assert sec["block_ids"] == ["block-0002", "block-0003", "block-0004", "block-0005"] and sec["pages"] == [2]


def test_noise(paper):
    kept, noise = blocks.split_noise(paper)
    assert rows(noise.orderBy("metadata_id"), "doc_id", "metadata_id", "page", "noise_reason") == [(1, "metadata-0001", 2, "repeated_header_footer"), (1, "metadata-0002", 3, "repeated_header_footer")]
    assert "Header of" not in kept.where("doc_id = 1").first()["text"]


def test_protected_spans(paper):
    got = spans.protected_spans(blocks.build_blocks(paper)).orderBy("span_id")
    assert [r[:2] for r in rows(got, "kind", "value", "start")] == [("url", "https://a.b/c"), ("inline_code", "`code`"), ("variable", "x_y"), ("code_block", "```py\na = 1\n\nb\n```"), ("doi", "10.1234/ab.c"), ("citation", "[12]"), ("inline_math", "$x$"), ("latex_command", "\\cite{k}")]


def test_page_windows(spark):
    seen = spark.createDataFrame([(1, "a", "ok"), (1, "b", "error"), (1, "b", "ok"), (2, "c", "ok")], "page int, block_id string, status string")
    want = spark.createDataFrame([(1, "a"), (1, "b"), (1, "x"), (2, "c")], "page int, block_id string")
    got = blocks.coverage_by_page(want, seen, ["page"], "block_id").orderBy("page")
    assert rows(got, "page", "expected", "missing", "duplicated", "errored", "coverage", "status") == [(1, 3, 1, 1, 1, 0.333, "warn"), (2, 1, 0, 0, 0, 1.0, "ok")]


def test_adjacent_pages(spark):
    a = "alpha bravo charlie delta echo foxtrot golf hotel " * 20
    b = "india juliet kilo lima mike november oscar papa " * 20
    left = spark.createDataFrame([(1, a), (2, b)], "page int, text string")
    right = spark.createDataFrame([(1, b), (2, b)], "page int, text string")
    got = blocks.adjacent_best_match(left, right).orderBy("page")
    assert rows(got, "page", "best_page", "status")[1] == (2, 1, "ok") and rows(got, "status")[0] == ("warn",)


def test_tails_references_and_merge(spark):
    b = spark.createDataFrame([(1, 1, "b1", 1, "x " * 60 + "understanding in 2021", "ok", "t1"), (1, 2, "b2", 1, "end", "bad", "")], "doc_id long, pos int, block_id string, page int, text string, status string, translation string")
    tail = blocks.page_tails(b).first()
    assert len(tail["tail"]) == 80 and tail["anchors"] == ["understanding", "2021"]
    assert blocks.merge_blocks(b).first()["text"] == "<!-- b1 -->\nt1\n\n<!-- b2 -->\n[untranslated]"
    lines = blocks.lines(spark.createDataFrame([(1, "a\nReferences\n\n12/3/2020\nitem")], "doc_id long, text string"))
    assert rows(blocks.reference_tail(lines), "line") == [("item",)]


def test_terms_and_policies(spark):
    docs = spark.createDataFrame([(1, "LLM and LLM use OpenThing. Neural Model Design here"), (2, "LLM The Of")], "doc_id long, text string")
    got = {r["term"]: r["kind"] for r in terms.candidate_terms(docs).collect()}
    assert got["LLM"] == "acronym" and got["OpenThing"] == "camel" and got["Neural Model Design"] == "phrase"
    layer = lambda r: spark.createDataFrame(r, "term string, expected string, action string")
    merged = terms.merge_layers([layer([("a", "x", "keep"), ("b", "y", "")]), layer([("a", "", "translate")])], "term", ["expected", "action"], ["default", "manual"])
    assert sorted(rows(merged, "term", "expected", "action", "policy_source")) == [("a", "x", "translate", "default+manual"), ("b", "y", "", "default")]
    pairs = spark.createDataFrame([("b1", "the LLM works", "法学硕士 有效"), ("b2", "the LLM works", "大型语言模型"), ("b3", "an LLM", "它"), ("b4", "none", "无")], "block_id string, source string, translation string")
    policies = spark.createDataFrame([("LLM", "LLM（大型语言模型）", "translate", ["法学硕士"])], "term string, expected string, action string, forbidden array<string>")
    assert sorted(rows(terms.check_policies(pairs, policies), "block_id", "severity")) == [("b1", "high"), ("b3", "medium")]
    q = spark.createDataFrame([("b1", "up 5% not 7 %", "增长5％")], "block_id string, source string, translation string")
    assert rows(terms.check_quantities(q), "missing", "added") == [(["7%"], [])]
    assert ("b1", "negation_lost") in rows(terms.check_drift(q), "block_id", "rule")
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    assert sorted(rows(terms.upsert(base, spark.createDataFrame([("b", ""), ("c", "3")], "k string, v string"), "k", ["v"]), "k", "v")) == [("a", "1"), ("b", "2"), ("c", "3")]
    lost = terms.check_protected(spark.createDataFrame([("b1", "译文")], "block_id string, translation string"), spark.createDataFrame([("b1", "url", "http://x.y"), ("b1", "variable", "a_b")], "block_id string, kind string, value string"))
    assert rows(lost, "kind", "severity") == [("url", "high")]


def test_best_fuzzy_equals_brute_force(spark, tmp_path, monkeypatch):
    """The query on whole lines and items: long ones, short ones, items after other words, edits at the start, ties."""
    monkeypatch.setattr(align, "NEEDLE_ROWS", 40)
    monkeypatch.setattr(align, "HAYSTACK_ROWS", 9)
    rng = random.Random(4)
    syllables = ["th", "er", "in", "on", "an", "re", "tion", "zu", "qua", "漢", "é", "k9", "x", "W"]

    def text(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))

    items = [(i, text(rng.choice([3, 12, 25, 45, 90, 160]))) for i in range(14)] + [(25, ""), (26, "...")]
    items += [(27, items[3][1]), (28, items[4][1].upper())]
    lines = [text(rng.randint(1, 60)) for _ in range(30)] + ["a", "th", "--", "{v1} th er"]
    for _, t in items[:14]:
        w = t.split()
        lines += [t, text(8) + " " + t, text(150) + " " + t, "X" + t[1:], t[: len(t) // 2], t[len(t) // 3 :], " ".join(x for x in w if rng.random() < 0.7), "".join(c for c in t if rng.random() < 0.75), "".join(c if rng.random() < 0.8 else "j" for c in t)]
    spark.createDataFrame([(i, "\n".join(lines[i::5])) for i in range(5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.fuzzy_match_difflib(spark, str(tmp_path)).collect()
    ids = {r["line_id"]: r["text"] for r in spark.createDataFrame([(" ".join(x.split()),) for x in lines], "text string").select("text", F.xxhash64("text").alias("line_id")).collect()}
    want = {}
    for line in ids.values():
        best, at = 0.0, None
        for i, t in items:
            score = align.match_score(line, t)
            if score > best:
                best, at = score, i
        if round(best, 4) >= 0.52:
            want[line] = (at, round(best, 4))
    assert {ids[r["line_id"]]: (r["item_id"], r["score"]) for r in got} == want
    assert len(want) == len(got) > 80 and sum(len(x) > 300 for x in want) > 5


def test_containment_with_short_needles(spark):
    texts = spark.createDataFrame([(1, "xx the quick brown fox jumps over it all yy"), (2, "the quick brown"), (3, "aquick b")], "doc_id long, text string")
    needles = spark.createDataFrame([(1, "he quick brown fox jumps over it al"), (2, "quick b"), (3, ""), (4, "nothing of this is in any of them")], "item_id long, needle string")
    got = align.containment(texts, needles, "doc_id", "text", "item_id", "needle")
    assert sorted(rows(got, "doc_id", "item_id")) == [(1, 1), (1, 2), (2, 2), (3, 2)]


def test_match_scores():
    assert align.match_score("some words", "some words") == 1.0
    assert align.match_score("some", "some words that go on and on for long") == 0.75
    assert align.match_score("", "x") == 0


def test_tracking(spark):
    lines = spark.createDataFrame([(1, 1, 0, "A visible line of source text"), (1, 1, 1, "Nothing tracked this line at all")], "doc_id long, page int, line_index int, text string")
    para = spark.createDataFrame([(1, "p1", 1, False, "a visible line of source text goes on", "一行可见的文字")], "doc_id long, debug_id string, page int, crosses boolean, input string, output string")
    assert rows(align.tracked(lines, para), "line_index") == [(1,)]
    assert rows(align.visible_after_translation(lines, para), "debug_id", "line_index") == [("p1", 0)]


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_spatial(spark):
    s = spark.createDataFrame([(1, 1, i, t, b, z, c, 600.0, 800.0) for i, t, b, z, c in [(1, "a", (0.0, 0.0, 10.0, 10.0), 12.0, 1), (2, "b", (2.0, 2.0, 12.0, 12.0), 5.0, 1), (3, "c", (100.0, 100.0, 110.0, 110.0), 9.0, 2), (4, "b", (3.0, 3.0, 13.0, 13.0), 9.0, 1)]], f"doc_id long, page int, span_id int, text string, bbox {BOX}, size double, color int, page_width double, page_height double")
    assert rows(spatial.overlaps(s).orderBy("a", "b"), "a", "b", "share") == [(1, 2, 0.64), (2, 4, 0.81)]
    assert rows(spatial.overlapping_count(s), "n") == [(2,)]
    assert rows(spatial.with_good_twin(s, 8.0), "span_id") == [(2,)]
    t = s.withColumn("size", F.when(F.col("span_id") == 1, 6.0).otherwise(F.col("size"))).where("span_id in (1, 3)")
    assert rows(spatial.nearest(s.where("span_id in (1, 3)"), t).orderBy("s"), "s", "t", "regressed") == [(1, 1, True), (3, 3, False)]
    ty = spatial.typography(s).first()
    assert (ty["under_6"], ty["to_14"], ty["color"], ty["color_share"]) == (1, 3, 1, 0.75)
    toc = spark.createDataFrame([(1, 1, "Intro", (50.0, 100.0, 90.0, 110.0), 600.0), (1, 1, "1", (500.0, 100.0, 510.0, 110.0), 600.0), (1, 1, "duction", (50.0, 120.0, 90.0, 130.0), 600.0), (1, 1, "2", (500.0, 121.0, 510.0, 131.0), 600.0), (1, 1, "99", (500.0, 300.0, 510.0, 310.0), 600.0)], f"doc_id long, page int, text string, bbox {BOX}, page_width double")
    assert rows(spatial.unpaired_numbers(toc), "text") == [("99",)]
    assert sorted(rows(spatial.toc_rows(toc.withColumn("column", F.lit(0))), "number", "title")) == [(1, "Intro"), (2, "duction")]
    order = spatial.reading_order(toc).where("column = 0").orderBy("nth")
    assert rows(order, "text") == [("Intro",), ("duction",)]


def test_quality_rollups(spark):
    issues = spark.createDataFrame([("a", "high"), ("a", "low"), ("b", "medium"), ("c", "low")], "category string, severity string")
    assert sorted(rows(quality.issue_rollup(issues, ["category"]), "category", "high", "status")) == [("a", 1, "fail"), ("b", 0, "warn"), ("c", 0, "pass")]
    gates = spark.createDataFrame([(1, "x", "ok"), (1, "y", "warn"), (2, "x", "blocking")], "run int, name string, status string")
    assert sorted(rows(quality.gate_rollup(gates, ["run"]), "run", "worst", "delivery")) == [(1, "warn", "delivered"), (2, "blocking", "partial")]
    assert sorted(rows(quality.gate_rollup(gates, ["run"], strict=True), "run", "delivery")) == [(1, "partial"), (2, "partial")]
    logs = spark.createDataFrame([(1, "Total paragraphs: 10\nfallback to simple\nfallback to simple"), (2, "Total paragraphs: 100\nAPI call\ncache hit")], "run_id int, log string")
    assert sorted(rows(quality.backend_quality(logs), "run_id", "fallback_ratio", "status")) == [(1, 0.2, "partial"), (2, 0.0, "ok")]
    pages = spark.createDataFrame([(1, 1), (1, 3)], "doc_id int, page int")
    assert rows(quality.page_coverage(pages, spark.createDataFrame([(1, 3), (2, 2)], "doc_id int, n_pages int")).orderBy("doc_id"), "missing_pages", "status") == [([2], "warn"), ([1, 2], "fail")]


def test_having_pages(spark):
    cjk = "这是一页中文内容而且相当长的文字"
    en = "these are ordinary English words that were left"
    lines = [(1, 2, i, en) for i in range(6)] + [(1, 2, 10 + i, cjk) for i in range(2)] + [(1, 3, 0, en), (1, 3, 1, cjk), (1, 4, 0, "References"), *[(1, 5, i, en) for i in range(6)], (1, 5, 9, cjk * 3)]
    got = quality.having_pages(spark.createDataFrame(lines, "doc_id long, page int, line_index int, text string"))
    assert {r[0] for r in rows(got, "page")} == {2} and got.count() == 6


def test_probe(spark):
    cases = [("translate", "This is an ordinary sentence to translate.", "This is an ordinary sentence to translate."), ("protect", "https://a.b/c", "https://a.b/c"), ("translate", "<style id='1'>Some text {v1} here</style>", "一些文字"), ("translate", "An ordinary English sentence.", "We need to translate the given text.")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, expected_behavior string, source string, output string")
    got = {r["id"]: r for r in quality.classify_probe(df).collect()}
    assert got[0]["same_as_input"] and got[0]["non_chinese"] and got[0]["ordinary_failure"]
    assert not any(got[1][f] for f in quality.PROBE_FLAGS)
    assert got[2]["placeholder_break"] and got[2]["style_tag_break"] and got[2]["protected_span_break"] and not got[2]["ordinary_failure"]
    assert got[3]["task_explanation"] and got[3]["ordinary_failure"]
    s = quality.probe_summary(quality.classify_probe(df), ["expected_behavior"]).where("expected_behavior = 'translate'").first()
    assert (s["total"], s["same_as_input"], s["placeholder_break_rate"], s["meets_thresholds"]) == (3, 2, 0.3333, False)


def tables():
    """A complete record of one question."""
    report = "# Summary\n" + "Enough text about the matter at hand to count as substance. " * 3 + "\n# Scope\ns\n# Limits\nl\n# Sources\n[A1] x\n## Answer one\nThe market grew by a lot in the last year [A1] as shown in the record.\n"
    none = {"Q1": []}
    return {
        "bundles": ([("B", "complete", report, {"executive_summary": "# Summary", "scope_and_method": "# Scope", "limitations": "# Limits", "sources": "# Sources"})], "bundle_id string, research_status string, report string, report_sections map<string,string>"),
        "questions": ([("B", 0, "Q1", "what?", "answered", "## Answer one", ["official_document"], False, ["freshness"], [], [], None, None)], "bundle_id string, pos int, question_id string, question string, status string, answer_section string, required_source_kinds array<string>, independent_evidence_required boolean, required_checks array<string>, required_objects array<string>, required_dimensions array<string>, current_evidence string, next_step string"),
        "sources": ([("B", 0, "A1", "t", "p", "https://a.b/c", None, "2024-01-02", "full_text", "host_opened_page", "official_document", "independent", ["Q1"])], "bundle_id string, pos int, source_id string, title string, publisher string, url string, published_at string, accessed_at string, access_status string, content_origin string, source_kind string, stakeholder_relation string, question_ids array<string>"),
        "claims": ([("B", 0, "K1", "current_fact", "The market grew by a lot", ["Q1"], ["A1"])], "bundle_id string, pos int, claim_id string, claim_type string, claim string, question_ids array<string>, source_ids array<string>"),
        "rounds": (
            [("B", i, f"R{i + 1}", k, ["Q1"], {"Q1": [s]}, {"Q1": c}, none, none, {"Q1": im}) for i, (k, s, c, im) in enumerate([("main_research", "primary_sources", [], "changed"), ("coverage_gap_check", "omission_scan", [], "narrowed"), ("adversarial_saturation_check", "counterevidence", ["freshness"], "none")])],
            "bundle_id string, pos int, round_id string, round_type string, target_question_ids array<string>, strategy_types map<string,array<string>>, checks_completed map<string,array<string>>, objects_checked map<string,array<string>>, dimensions_checked map<string,array<string>>, conclusion_impact map<string,string>",
        ),
    }


def bundle(spark, **change):
    """That record as DataFrames, with tables replaced."""
    return {name: spark.createDataFrame(change[name](data) if name in change else data, schema) for name, (data, schema) in tables().items()}


def replaced(row, **at):
    out = list(row)
    for i, v in at.items():
        out[int(i[1:])] = v
    return tuple(out)


MUTATIONS = [
    ("bundles", lambda d: [replaced(d[0], _2=d[0][2].replace("[A1]", "[A9]"))], "unknown_report_citation"),
    ("bundles", lambda d: [replaced(d[0], _2="# Summary\nx")], "report_too_short"),
    ("bundles", lambda d: [replaced(d[0], _3={**d[0][3], "limitations": "# Nope"})], "report_section_missing"),
    ("bundles", lambda d: [replaced(d[0], _3={**d[0][3], "limitations": "# Scope"})], "report_sections_not_distinct"),
    ("questions", lambda d: d + [replaced(d[0], _1=1)], "duplicate_question_id"),
    ("questions", lambda d: [replaced(d[0], _4="maybe")], "question_status_invalid"),
    ("questions", lambda d: [replaced(d[0], _4="unanswered")], "complete_question_not_answered"),
    ("questions", lambda d: [replaced(d[0], _5="## Elsewhere")], "question_answer_section_missing"),
    ("questions", lambda d: [replaced(d[0], _6=["journalism"])], "question_source_kinds_not_covered"),
    ("questions", lambda d: [replaced(d[0], _6=["x"])], "question_required_source_kinds_invalid"),
    ("questions", lambda d: [replaced(d[0], _8=["freshness", "counterevidence"])], "question_checks_not_completed"),
    ("questions", lambda d: [replaced(d[0], _9=["thing"])], "question_objects_not_checked"),
    ("questions", lambda d: [], "questions_missing"),
    ("sources", lambda d: d + [replaced(d[0], _1=1, _2="A2", _5="https://a.b:443/c/?utm_s=1#x")], "duplicate_source_url"),
    ("sources", lambda d: [replaced(d[0], _7="2024-02-30")], "source_accessed_at_invalid"),
    ("sources", lambda d: [replaced(d[0], _8="metadata_only")], "claim_source_not_substantive"),
    ("sources", lambda d: [replaced(d[0], _12=["Q9"])], "source_unknown_question"),
    ("sources", lambda d: [replaced(d[0], _2="Q1")], "identifier_namespace_collision"),
    ("claims", lambda d: [replaced(d[0], _4="Something never said")], "claim_source_not_cited_with_claim"),
    ("claims", lambda d: [replaced(d[0], _6=["A7"])], "claim_unknown_source"),
    ("claims", lambda d: [replaced(d[0], _3="odd")], "claim_type_invalid"),
    ("rounds", lambda d: [d[0], replaced(d[2], _1=1), replaced(d[1], _1=2)], "research_round_order_invalid"),
    ("rounds", lambda d: d[:2], "research_round_question_not_covered"),
    ("rounds", lambda d: [d[0], d[1], replaced(d[2], _9={"Q1": "changed"})], "question_not_saturated"),
    ("rounds", lambda d: [d[0], d[1], replaced(d[2], _5={"Q1": ["primary_sources"]})], "question_saturation_strategy_not_adversarial"),
    ("rounds", lambda d: d + [replaced(d[0], _1=3, _2="R4")], "question_changed_after_saturation"),
    ("rounds", lambda d: [replaced(d[0], _4=["Q1", "Q9"]), d[1], d[2]], "research_round_unknown_question"),
]


def test_complete_record_has_no_findings(spark):
    b = bundle(spark)
    found = research.validate(**b)
    assert rows(found, "code", "args") == []
    status = research.delivery_status(b["bundles"], spark.createDataFrame([("B", "pass")], "bundle_id string, review_status string"), found)
    assert rows(status, "delivery_status") == [("reviewed_pass",)]


@pytest.fixture(scope="module")
def codes(spark):
    """Codes found for each mutated record; all records are validated together."""
    data, schemas = {}, {}
    for k, (table, change, _) in enumerate(MUTATIONS):
        for name, (rows_, schema) in tables().items():
            schemas[name] = schema
            made = change(rows_) if name == table else rows_
            data.setdefault(name, []).extend((f"M{k}", *r[1:]) for r in made)
    found = research.validate(**{n: spark.createDataFrame(data[n], schemas[n]) for n in data})
    out = {}
    for b, c in rows(found, "bundle_id", "code"):
        out.setdefault(b, set()).add(c)
    return out


@pytest.mark.parametrize("k", range(len(MUTATIONS)), ids=[m[2] for m in MUTATIONS])
def test_one_fault_is_found(codes, k):
    assert MUTATIONS[k][2] in codes.get(f"M{k}", set())


def test_stop_and_review(spark):
    b = bundle(spark, questions=lambda d: [replaced(d[0], _9=["thing"])])
    diag = research.coverage_diagnostics(b["bundles"], b["questions"], b["sources"], b["rounds"])
    declared = spark.createDataFrame([("B", "object", "Q1", "other")], "bundle_id string, gap_type string, question_id string, item string")
    assert sorted(rows(research.check_stop(declared, diag), "code", "args")) == [("stop_gap_not_declared", ["object", "Q1", "thing"]), ("stop_gap_not_derived", ["object", "Q1", "other"])]
    s = lambda r, t: spark.createDataFrame(r, t)
    got = research.check_review(s([("B", "question", 2)], "bundle_id string, kind string, n long"), s([("B", "question", "Q1", "complete")], "bundle_id string, kind string, id string, status string"), s([("B", "question", "Q2")], "bundle_id string, kind string, id string"), s([("B", "f", "x")], "bundle_id string, file string, sha256 string"), s([("B", "f", "y")], "bundle_id string, file string, sha256 string"))
    assert sorted(r[0] for r in rows(got, "code")) == ["review_candidate_hash_mismatch", "review_count_mismatch", "review_item_missing"]


def test_routing(spark):
    packs = spark.createDataFrame([("travel-planning", ["行程"], ["multi-user"]), ("finance-tax-contract", ["Excel"], ["financial-data"])], "domain_id string, keywords array<string>, risk_triggers array<string>")
    req = spark.createDataFrame([(1, "家庭旅行 行程 excel", "travel-planning", [], None, ["行程"])], "request_id int, text string, primary_domain string, auxiliary_domains array<string>, profile_id string, evidence_spans array<string>")
    assert rows(routing.route_scores(req, packs).orderBy("rank"), "domain_id", "score") == [("travel-planning", 18), ("finance-tax-contract", 2)]
    assert rows(routing.risks(req, packs), "risks") == [(["multi-user"],)]
    profiles = spark.createDataFrame([("travel-planning", "p1")], "domain_id string, profile_id string")
    assert rows(routing.route_errors(req, packs, profiles), "code") == []
    bad = req.withColumn("primary_domain", F.lit("x")).withColumn("evidence_spans", F.array(F.lit("没有"))).withColumn("profile_id", F.lit("p1"))
    assert {r[0] for r in rows(routing.route_errors(bad, packs, profiles), "code")} == {"primary_domain_invalid", "evidence_span_invalid", "profile_invalid"}
    fb = spark.createDataFrame([("第 3 页颜色太暗，字体太小",)], "t string")
    assert fb.select(routing.feedback_dimensions(F.col("t")), routing.feedback_page(F.col("t"))).first()[:] == (["color", "typography"], 3)


def test_events(spark):
    ev = spark.createDataFrame([(1, 0, "e1", 1, "a"), (1, 1, "e1", 3, "b"), (1, 2, "e3", 2, " ")], "run_id int, pos int, event_id string, turn_index int, raw_text string")
    assert sorted(rows(events.order_errors(ev), "event_id", "code")) == [("e1", "event_id_duplicate"), ("e3", "raw_text_empty"), ("e3", "turn_index_not_increasing")]
    runs = spark.createDataFrame([(1, i, x) for i, x in enumerate(["propose", "confirm", "build", "odd", "evaluate_pass"])] + [(2, 0, "build")], "run_id long, pos int, intent string")
    a = [(1, "local_delivered", "delivered", 4, 1), (2, "intake", "active", 0, 1)]
    assert sorted(rows(events.run_states_native(runs), "run_id", "state", "status", "moves", "refused")) == a
    long = [(r, i, random.Random(100 * r + i).choice(["propose", "confirm", "revise", "build", "evaluate_pass", "evaluate_fail", "answer", "clarify"])) for r in range(5) for i in range(40)]
    want = [(r, *events.fold([x for q, _, x in long if q == r])[:4]) for r in range(5)]
    for chunk in (1, 7, 1000):  # runs are folded in chunks, whatever their length
        got = events.run_states_native(spark.createDataFrame(long, "run_id long, pos int, intent string").repartition(3), chunk)
        assert sorted(rows(got, "run_id", "state", "status", "moves", "refused")) == want
    days = spark.createDataFrame([(1, f"2024-01-{d:02d}") for d in (1, 2, 3, 5, 6, 6)], "user_id int, d string")
    assert rows(events.streaks(days, "user_id", "d"), "streak") == [(2,)]
    rec = spark.createDataFrame([("a", {"n": "1.5", "d": "2024-01-01"}), ("b", {"n": "x"}), ("c", {"zz": "1"})], "id string, values map<string,string>")
    good, bad = events.import_records(rec, {"n": "number", "d": "date"})
    assert rows(good, "id", "n") == [("a", 1.5)] and sorted(rows(bad, "id")) == [("b",), ("c",)]
    tries = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "z")], "row_id int, attempt int, output string")
    assert rows(events.retry_outcome(tries), "attempts", "output", "delay") == [(3, "z", 1.0)]


def test_streams_equal_batches(spark, tmp_path):
    from quillspark.runtime import prepare
    from quillspark.streaming import ledgers

    prepare(spark)
    src = f"{tmp_path}/in"
    rows_ = [(k % 3, k, x, f"2024-01-0{1 + k // 4} 10:00:00") for k, x in enumerate(["propose", "propose", "build", "confirm", "revise", "clarify", "build", "propose", "propose"])]
    df = spark.createDataFrame(rows_, "run_id long, pos int, intent string, t string").selectExpr("run_id", "pos", "intent", "timestamp(t) ts")
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = ledgers.run_states(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(rows(spark.table("states"), "run_id", "state", "status", "moves", "refused")) == sorted(rows(events.run_states_native(df), "run_id", "state", "status", "moves", "refused"))
    q = ledgers.keyed_counts(stream, ["intent"]).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["n"] for r in spark.table("counts").collect()) == len(rows_)


def test_sources(spark, tmp_path):
    from quillspark.sources import readers as R

    assert R.visible_text("<p>a &amp; b<script>x</script><br>c</p><style>y</style><nav>n</nav>") == "a & b\nc\nn"
    xml = '<doc xmlns="urn:x"><page width="600" height="800"><line xMin="1" yMin="2" xMax="3" yMax="4"><word xMin="1" yMin="2" xMax="2" yMax="4">a&nbsp;b</word><word xMin="2" yMin="2" xMax="3" yMax="4">c</word></line></page></doc>'
    line = R.bbox_lines(spark.createDataFrame([(1, xml), (2, "<broken")], "doc_id long, xhtml string")).first()
    assert (line["page"], line["line_index"], line["bbox"]["y1"], len(line["words"])) == (1, 0, 4.0, 2) and line["text"].endswith("c")
    track = '{"page":[{"paragraph":[{"debug_id":"a","input":"x","llm_translate_trackers":[{"fallback_to_translate":true}]}]},{"page":7,"paragraph":[{"debug_id":"b"}]}],"cross_page":[{"paragraph":[{"debug_id":"c"}]}]}'
    got = R.tracking_paragraphs(spark.createDataFrame([(1, track)], "doc_id long, payload string")).orderBy("debug_id")
    assert rows(got, "tracking_group", "page", "debug_id", "fallback") == [("page", 1, "a", True), ("page", 7, "b", False), ("cross_page", None, "c", False)]
    tex = R.latex_document(spark.createDataFrame([(1, "\\title{A {b} c}\\begin{document}\\begin{abstract}abs\\end{abstract}\\section{One} text % no\n\\end{document}")], "doc_id long, text string")).first()["text"]
    assert tex.startswith("# A {b} c") and "## Abstract\nabs" in tex and "## One" in tex and "no" not in tex.split("text")[1]
    kinds = spark.createDataFrame([("a.MD",), ("b.tex",), ("c.pdf",), ("d.xyz",)], "p string").select(R.input_type(F.col("p")))
    assert [r[0] for r in kinds.collect()] == ["text", "latex", "pdf", "unsupported_layout"]
    att = spark.createDataFrame([(1, "error", "file is encrypted"), (1, "ok", None), (2, "error", "not installed"), (3, "ok", "")], "doc_id int, status string, error string")
    assert sorted(rows(R.pdf_failure(att), "doc_id", "failure")) == [(1, "protected_pdf"), (2, "needs_pdf_dependency"), (3, "needs_ocr")]
    g = spark.createDataFrame([("t", "译", "keep") + ("",) * 7], ", ".join(f"{c} string" for c in R.GLOSSARY))
    R.write_glossary(g, f"{tmp_path}/g")
    assert rows(R.read_glossary(spark, f"{tmp_path}/g"), "source_term", "translation", "note") == [("t", "译", "")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/x.jsonl").write_text('{"a":1}\n\nbroken\n[1]\n{"a":2}\n')
    assert sorted(r[0] for r in rows(R.read_records(spark, f"{tmp_path}/j", "a int"), "a") if r[0]) == [1, 2]
    bad = R.guarded_json(spark.createDataFrame([('{"a":1}',), ("{x",), (None,)], "j string"), "j", "a int", "error")
    assert [(r["parsed"]["a"], r["error"]) for r in bad.collect()] == [(1, None), (None, "invalid_json"), (None, None)]
    files, digest = R.read_tree(spark, f"{tmp_path}/j")
    assert files.count() == 1 and len(digest.first()["digest"]) == 64
    v = R.commit(spark, {"x": g}, f"{tmp_path}/store")
    assert spark.read.parquet(f"{tmp_path}/store/{v}/x").count() == 1
    assert R.markdown_table(g.select("source_term")) == "| source_term |\n| --- |\n| t |"


def test_cut_references_stay():
    """Only references with their semicolon are read, as in the query's SQL."""
    from quillspark.sources import readers as R

    page = "<title>x&amp;&amp</title><p>a &am & &copy 1 &copy;&ampfoo; &#38;lt; &amp;lt; &lt;b&gt;<i title='&amp'>y</i></p>"
    assert R.visible_text(page) == "x&&amp\na &am & &copy 1 ©&ampfoo; &lt; &lt; <b> y"
    assert R.visible_text("&amp") == "&amp"


def test_contents_rows_at_one_height(spark):
    """Numbers at one height: the order of the input doesn't say which takes the titles."""
    from itertools import permutations

    titles = [(1, 0, 0, 20.0, 5.0, "Title")]
    numbers = [(1, 0, 0, 20.0, 90.0, "7"), (1, 0, 0, 20.0, 80.0, "45"), (1, 0, 0, 20.0, 80.0, "12")]
    seen = set()
    for order in permutations(numbers):
        df = spark.createDataFrame([*order, *titles], "doc_id long, page int, column int, y double, x double, text string").coalesce(1)
        got = spatial.toc_rows(df.withColumn("bbox", F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"))))
        seen.add(tuple(rows(got, "number", "title")))
    assert seen == {((12, "Title"),)}
