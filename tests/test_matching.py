"""Blocks of a source and of a layout, against a plain form of the rules; bounds of rule tables."""

import difflib
import random
import re

import pytest

from quillspark import runtime
from quillspark.operators import align, rewrites, rulebook

SOURCE = "doc_id long, pos int, block_id string, page int, text string, element_type string"
LAYOUT = "doc_id long, pos int, block_id string, page int, text string, layout_role string, engine_block_id string"
STOP = {"the", "and", "for", "with", "from", "this", "that", "into", "are", "was", "were"}


def norm(t):
    return " ".join(re.sub(r"<[^>]+>", " ", t or "").split()).lower()


def canon(t):
    return re.sub(r"[^a-z0-9一-鿿]+", " ", norm(t)).strip()


def tokens(t):
    return {x for x in re.findall(r"[a-z0-9]+|[一-鿿]", canon(t)) if (len(x) > 1 or x > "一") and x not in STOP}


def likeness(a, b):
    a, b, ca, cb = norm(a), norm(b), canon(a), canon(b)
    if not a or not b:
        return 0
    n, m = sorted((len(a), len(b)))
    if len(ca) >= 32 and ca in cb:
        return 0.72
    if n >= 24 and (a[:n] in b or b[:n] in a):
        return 0.92
    if a in b or b in a:
        return 0.88 * (n >= 0.45 * m)
    return difflib.SequenceMatcher(None, a[:600], b[:600]).ratio()


def plain(source, layout):
    """What each block of one document is matched with, by trying the ways in turn."""
    used, out = set(), []
    engine = any(x[6] for x in layout)
    last = {x[2]: x[1] for x in layout if x[2]}
    name = {x[1]: x[2] for x in layout}
    for _, _, block_id, page, text, kind in source:
        fits = [x for x in layout if page is None or x[3] is None or page == x[3]]
        own = tokens(text)

        def one(free):
            best = max(((likeness(text, x[4]), -x[1]) for x in fits if x[1] in free), default=(0, 0))  # noqa: B023
            return ([-best[1]], round(best[0], 3)) if best[0] >= 0.52 else None

        def many(free):
            if len(own) < 6:  # noqa: B023
                return None
            got, picked = set(), []
            for x in sorted((x for x in fits if x[1] in free and own & tokens(x[4])), key=lambda x: -len(own & tokens(x[4]))):  # noqa: B023
                if len(got) < 0.85 * len(own) and own & tokens(x[4]) - got:  # noqa: B023
                    picked.append(x[1])
                    got |= own & tokens(x[4])  # noqa: B023
            share = round(len(got) / len(own), 3)  # noqa: B023
            return (picked, share) if len(picked) > 1 and share >= 0.45 else None

        def head(_):
            c = canon(text)  # noqa: B023
            hits = [x[1] for x in layout if "heading" in (x[5] or "") and canon(x[4]) == c]
            return (hits[:1], 1.0) if kind == "heading" and 0 < len(c) <= 48 and hits else None  # noqa: B023

        if block_id in last:
            out.append((block_id, [name[last[block_id]]], "block_id", 1.0))
            continue
        free, every = {x[1] for x in layout} - used, {x[1] for x in layout}
        ways = [("page_text_similarity", one, free), ("page_composite_text_coverage", many, free)]
        if text.count("\n") >= 2 and len(own) >= 8:
            ways.insert(0, ways[1])
        if engine:
            ways += [("shared_page_text_similarity", one, every), ("shared_section_heading_text_exact", head, every), ("shared_page_composite_text_coverage", many, every)]
        for method, way, pool in ways:
            if hit := way(pool):
                if not method.startswith("shared_"):
                    used |= set(hit[0])
                out.append((block_id, [name[i] for i in hit[0]], method, hit[1]))
                break
        else:
            out.append((block_id, [], "unmatched", 0.0))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_blocks_match_as_by_the_plain_rules(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["alpha", "bravo", "charlie", "delta", "echo", "the", "foxtrot", "golf", "hotel", "和", "india", "juliet", "x1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    source, layout = [], []
    for doc in range(3):
        for i in range(14):
            t = text(rng.choice([1, 3, 8, 14]))
            if i % 3 == 0:
                t = t.replace(" ", "\n", 3)
            kind = "heading" if i % 5 == 0 else "paragraph"
            source.append((doc, i, f"s{i}" if i % 6 else f"l{i}", rng.choice([1, 2, None]), t, kind))
            parts = rng.choice([[t], [t.upper() + " more"], t.split("\n"), [t[: len(t) // 2], t[len(t) // 2 :]], [text(6)], []])
            for p in parts:
                layout.append((doc, len(layout), f"l{len(layout) % 40}", rng.choice([1, 2, None]), p, rng.choice(["section_heading", "body", None]), "e" if doc == 1 else None))
    rng.shuffle(layout)
    layout.sort(key=lambda x: (x[0], x[1]))
    got = {}
    for r in align.match_blocks(spark.createDataFrame(source, SOURCE).repartition(3), spark.createDataFrame(layout, LAYOUT).repartition(3)).collect():
        got.setdefault(r["doc_id"], {})[r["block_id"]] = (r["layout_ids"], r["method"], r["score"])
    methods = set()
    for doc in range(3):
        want = plain([x for x in source if x[0] == doc], [x for x in layout if x[0] == doc])
        for block_id, ids, method, score in want:
            methods.add(method)
            assert got[doc][block_id][1] == method, (doc, block_id, got[doc][block_id], ids, method, score)
            assert got[doc][block_id][0] == ids and got[doc][block_id][2] == pytest.approx(score, abs=1e-9)
    assert {"block_id", "page_text_similarity", "unmatched"} <= methods


def test_covers():
    part = lambda i, t: (i, frozenset(t.split()))
    assert align.cover(6, [part(1, "a b c"), part(2, "d e f"), part(3, "a")]) == ([1, 2], 1.0)
    assert align.cover(6, [part(1, "a b c d e f"), part(2, "a")]) == ([], 0.0)  # one is no composite
    assert align.cover(10, [part(1, "a b"), part(2, "c")]) == ([], 0.0)  # too little
    assert align.cover(6, []) == ([], 0.0)


def test_documents_without_a_layout(spark):
    s = spark.createDataFrame([(1, 1, "s1", 1, "some text", "paragraph"), (2, 1, "s1", None, None, None)], SOURCE)
    got = align.match_blocks(s, spark.createDataFrame([], LAYOUT)).collect()
    assert sorted((r["doc_id"], r["layout_ids"], r["method"], r["score"]) for r in got) == [(1, [], "unmatched", 0.0), (2, [], "unmatched", 0.0)]


def test_rule_tables_are_bounded(spark):
    """A table that meets every row of another is broadcast by its count, or an error; never a nested loop."""
    many = spark.range(runtime.SMALL_ROWS + 1)
    with pytest.raises(ValueError, match="split it"):
        runtime.small(many)
    pages = spark.createDataFrame([(1, 1, "Overview\nTable 1 x")], "doc_id long, page int, text string")
    for df in (rewrites.page_rules(pages, rulebook.page_rule_rows(spark)), rulebook.line_rules(pages, rulebook.line_rule_rows(spark)), rulebook.dropped_table_texts(pages, pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
    got = {r["rule"] for r in rulebook.semantic_findings(pages).collect()}
    assert got == {"section_heading_untranslated", "table_caption_untranslated"}


def test_order_of_characters_bounds_the_ratio(monkeypatch):
    """Common subsequences are counted right, bound every ratio, and spare the matcher texts of like characters."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randint(1, 30))) for _ in range(40)]
    hay = align.Haystacks(texts, 0.52)
    for a in hay.texts:
        for i, b in enumerate(hay.texts):
            row = [0] * (len(b) + 1)
            for x in a:
                last = row
                row = [0]
                for j, y in enumerate(b):
                    row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
            assert hay.in_order(a, i) == row[-1]
            if a or b:
                full = difflib.SequenceMatcher(None, a, b).ratio()
                assert 2.0 * row[-1] / (len(a) + len(b)) >= full and hay.ratio(a, i, 0.0) == full
    hay = align.Haystacks(["abcdefghijklmnopqrstuvwxyz0123456789"], 0.52)
    calls = []
    monkeypatch.setattr(difflib.SequenceMatcher, "find_longest_match", lambda *a: calls.append(a))
    assert hay.best("9876543210zyxwvutsrqponmlkjihgfedcba") is None and not calls


def test_many_needles_at_once(monkeypatch):
    """Needles in one call get what brute force finds, and the bounds leave the matcher none of unlike texts."""
    rng = random.Random(8)
    syllables = ["th", "er", "in", "on", "tion", "zu", "qua", "漢", "字", "é", "k9", "x", "W", " ", " ", " "]
    text = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    texts = [text(rng.choice([2, 20, 70, 130, 300])) for _ in range(25)] + ["", "..."]
    needles = [text(rng.choice([1, 5, 40, 90, 200, 900])) for _ in range(40)] + ["", "--", "<style a>th er{v1}", "th" * 80, texts[3]]
    needles += ["".join(c for c in t if rng.random() < 0.7) for t in texts] + [t[: len(t) // 2] + text(9) for t in texts]
    want = []
    for a in needles:
        scores = [align.match_score(a, t) for t in texts]
        best = max(scores)
        want.append((scores.index(best), best) if best >= 0.52 - 5e-5 else None)
    for alone in (1, 10, 1000):
        monkeypatch.setattr(align.Haystacks, "ALONE", alone)
        monkeypatch.setattr(align.Haystacks, "PAIRS", 7 * alone)
        got = align.Haystacks(texts, 0.52).best_of_all(needles)
        assert [g and (g[0], pytest.approx(g[1], abs=1e-12)) for g in got] == want
    assert 20 < sum(x is not None for x in want) < len(want) - 20
    letters = [chr(i) for i in range(ord("a"), ord("z") + 1)]
    hay = align.Haystacks(["".join(rng.sample(letters, 26)) for _ in range(30)], 0.52)
    monkeypatch.setattr(align.Haystacks, "in_order", lambda *a: pytest.fail("a text was compared alone"))
    assert hay.best_of_all([t[::-1] for t in hay.texts[:5]] + ["z" * 30]) == [None] * 6


def test_lines_are_not_made_for_their_count(spark, tmp_path, monkeypatch):
    """The query's teams are set by a plain count; too low or too high, it changes no row."""
    from pyspark.sql.classic.dataframe import DataFrame

    from quillspark import queries

    texts = ["the quick brown fox\njumps over", None, "", "a lazy dog sleeps here\nthe quick brown fix"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.createDataFrame([(1, "quick brown foxes"), (2, "a lazy dog slept")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    counted, count = [], DataFrame.count
    monkeypatch.setattr(DataFrame, "count", lambda self: counted.append(self.columns) or count(self))
    got = sorted(map(tuple, queries.fuzzy_match_difflib(spark, str(tmp_path)).collect()))
    assert len(got) == 3 and ["line_id", "text"] not in counted
    left = spark.createDataFrame([(i, t) for i, t in enumerate("the quick brown fox|jumps over|a lazy dog sleeps here".split("|"))], "line_id long, text string")
    few, many = (sorted(map(tuple, align.best_fuzzy(left, items, "line_id", "item_id", [], about=n).collect())) for n in (0, 40_000))
    assert few == many and len(few) == 2
