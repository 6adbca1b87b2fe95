import random
import zlib

import pytest
from made import words
from pyspark.sql import functions as F

from quillspark.llm import langid, license, quality

SYLLABLES = {"aa": "ka to mi ra su ne ho", "bb": "schl ung ein ver ßt üb acht", "cc": "ción ado ñez lla que por"}


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(4)
    out = []
    for i in range(300):
        lang = rng.choice(list(SYLLABLES))
        s = SYLLABLES[lang].split()
        t = " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(6, 60)))
        out.append((i, t.upper() if i % 9 == 0 else t, lang if i % 11 else None))
    return out, spark.createDataFrame(out, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit("y"))


def test_languages_held_out(spark, tongues):
    rows, df = tongues
    got = {r["doc_id"]: r for r in langid.identify_languages(spark, df).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["held_out"] == held(i) and 0 <= got[i]["score"] <= 1 for i, _, _ in rows)
    truth = [(i, g) for i, _, g in rows if g and held(i)]
    assert sum(got[i]["lang_pred"] == g for i, g in truth) >= 0.97 * len(truth)


def test_labels_of_held_out_rows_do_not_matter(spark, tongues):
    rows, df = tongues
    hidden = langid.held_out("doc_id")
    other = df.withColumn("lang", F.when(hidden, "zz").otherwise(F.col("lang")))
    key = lambda x: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in langid.identify_languages(spark, x).collect())
    assert key(df) == key(other)


def test_kernel_scores_equal_unfolded_formula():
    import numpy as np

    rng = random.Random(8)
    texts = [(" ".join(rng.choice(SYLLABLES[g].split()) for _ in range(20)), g) for g in SYLLABLES for _ in range(12)]
    marks = [t for t, _ in texts[::4]]
    m = langid.fit(marks, [t for t, _ in texts], [g for _, g in texts])
    grams = langid.Grams()
    width = m.weights.shape[0]
    p, _ = langid._presence(grams, m.slot, width, [t for t, _ in texts])
    k = lambda a, b: np.array([[len(set(np.flatnonzero(x)) & set(np.flatnonzero(y))) / np.sqrt(x.sum() * y.sum()) for y in b] for x in a])
    pm, _ = langid._presence(grams, m.slot, width, marks)
    assert np.allclose(k(p, pm), (p / np.sqrt(p.sum(1, keepdims=True))) @ (pm / np.sqrt(pm.sum(1, keepdims=True))).T, atol=1e-5)
    assert (m.scores(p).argmax(axis=1) == [m.languages.index(g) for _, g in texts]).all()


def test_undetermined(spark, docs, empty):
    got = {r["doc_id"]: r for r in langid.identify_languages(spark, docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for i, t in texts.items():
        letters = any(c.isalpha() for c in t or "")
        assert (got[i]["lang_pred"] == "und") == (not letters), t
        assert letters or got[i]["score"] == 0
    assert langid.identify_languages(spark, empty).collect() == []
    kept = langid.with_known_language(spark, docs)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} <= {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}


def test_every_language_is_learned(spark, monkeypatch):
    """Far more languages than one used to learn, each with letters of its own; too many are an error, not a loss."""
    rows = [(3 * (i * 4 + j) + (i * 4 + j) % 2, " ".join(chr(0x4E00 + 7 * i + k) * 2 for k in range(5)), f"l{i:03d}") for i in range(230) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.languages == sorted({r[2] for r in rows if not held(r[0])}) and len(model.languages) > 220
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 100)
    with pytest.raises(ValueError, match="more than 100 languages"):
        langid.train(df)


def test_rows_keep_their_columns_and_repeats(spark):
    rows = [(i, "ka to mi ra su ne ho ka to mi ra", "aa", "x") for i in range(8)] + [(50 + i, "schl ung ein ver üb acht ung schl", "bb", "y") for i in range(8)] + [(None, "ka to mi ra su ne ho", None, None), (99, None, "aa", "z"), (99, "123", "aa", "z")]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string, _of string")
    got = sorted(map(tuple, langid.with_known_language(spark, df).collect()), key=repr)
    assert got == sorted([r for r in rows + rows[:1] if r[1] not in (None, "123")], key=repr)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.identify_languages(spark, df).collect()} == {("und", 0.0)}


def test_quality_held_out(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        w = ["".join(rng.choice("abcdeop") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(10, 80))]
        bad = i % 3 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x for x in w for _ in range(4)]
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score_quality(spark, df, lab).collect()}
    test = [(i, y) for i, y in labels if held(i)]
    assert all(got[i]["held_out"] for i, _ in test)
    assert sum(got[i]["predicted"] == y for i, y in test) >= 0.95 * len(test)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    flipped = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, y in labels], "doc_id long, quality int")
    again = {r["doc_id"]: r["score"] for r in quality.score_quality(spark, df, flipped).collect()}
    assert all(again[i] == pytest.approx(got[i]["score"], abs=1e-9) for i in again)


def test_quality_edges(spark, docs, rows, empty):
    lab = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1)], "doc_id long, quality int")
    got = quality.score_quality(spark, docs, lab).collect()
    assert len(got) == len(rows) and {r["score"] for r in got} == {0.5}
    assert quality.score_quality(spark, empty, lab).collect() == []


def test_ftrl_equals_plain_loop():
    import math

    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(64, 5, replace=False)), rng.random(5)) for _ in range(30)]
    y = np.array([int(r[0][0] < 9) for r in rows])
    got = quality.train_ftrl(rows, y, bits=6, epochs=2)
    z, n = [0.0] * 65, [0.0] * 65
    weigh = {1: 0.5 / y.mean(), 0: 0.5 / (1 - y.mean())}

    def w(i):
        return 0.0 if abs(z[i]) <= quality.L1 else (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for r in order.permutation(30):
            f = [*zip(rows[r][0].tolist(), rows[r][1].tolist()), (64, 1.0)]
            p = 1 / (1 + math.exp(-sum(w(i) * x for i, x in f)))
            for i, x, wi in [(i, x, w(i)) for i, x in f]:
                g = (p - y[r]) * weigh[y[r]] * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * wi
                n[i] += g * g
    assert np.allclose(got, [w(i) for i in range(65)])


def test_licences(spark, rows):
    notices = {"apache-2.0": "Licensed under the Apache License, Version 2.0.", "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.", "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.", "mit": "Copyright 2020 Some Authors. Released under the MIT License.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "cc-by-sa": "licensed under cc by-sa 4.0"}
    plain = [(r[0], r[1]) for r in rows if r[0] is not None][:80]
    made = [(1000 + i, f"{plain[i][1] or ''}\n{t}\nmore text here") for i, t in enumerate(notices.values())]
    df = spark.createDataFrame(plain + made + [(2000, None), (2001, ""), (2002, "The terms of this version are read by the team under the bridge.")], "doc_id long, text string").withColumn("family", F.lit("x"))
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in license.scan_licenses(spark, df).collect()}
    assert got == {(1000 + i, made[i][1].count("\n") - 1, f) for i, f in enumerate(notices)}


def test_licences_inside_long_paragraphs(spark):
    """One template of each family amid 0 to 400 words of one line, and two notices in one line."""
    rng = random.Random(6)
    prose = lambda n: words(rng, n, "aeinorst")
    plain = [(i, "\n".join(prose(rng.randint(10, 60)) for _ in range(3))) for i in range(60)]
    texts, want = [], set()
    for family, templates in license.TEMPLATES.items():
        for t in templates:
            for around in (0, 10, 40, 200):
                d = 1000 + len(texts)
                texts.append((d, f"{prose(around)} {t} {prose(around)}".strip()))
                want.add((d, family))
    texts.append((5000, f"{prose(90)} Released under the MIT License. {prose(90)} This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. {prose(90)}"))
    want |= {(5000, "mit"), (5000, "cc-by-nc")}
    got = {(r["doc_id"], r["family"]) for r in license.scan_licenses(spark, spark.createDataFrame(plain + texts, "doc_id long, text string")).collect()}
    assert len(want & got) >= 0.97 * len(want), sorted(want - got)
    assert len(got - want) <= 0.03 * len(want), sorted(got - want)
    assert {d for d, _ in got} & set(range(60)) == set()


def wrapped(text, width):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            out.append(line.strip())
            line = ""
        line += w + " "
    return "\n".join([*out, line.strip()])


def test_licences_wrapped_over_lines(spark):
    """A notice that is wrapped is found on the line that it begins on; a blank line ends a paragraph."""
    rng = random.Random(8)
    prose = lambda n: words(rng, n, "aeinorst")
    texts, want = [(i, prose(40)) for i in range(60)], set()
    for family, templates in license.TEMPLATES.items():
        t = max(templates, key=len)
        if len(license.tokens(t)) >= 20:
            d = len(texts) + 100
            texts.append((d, f"{prose(9)}\n\n{prose(5)}\n{wrapped(t, 30)}\n\n{prose(8)}"))
            want.add((d, 3, family))
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in license.scan_licenses(spark, spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == want and len(want) >= 8


def test_licence_edges(spark, empty):
    """No rows, no text, blank lines, one very long text, repeated rows."""
    assert license.scan_licenses(spark, empty).collect() == []
    rng = random.Random(9)
    notice = "Released under the MIT License."
    rows = [(i, words(rng, 30, "aeinorst")) for i in range(50)] + [(60, None), (61, ""), (62, "\n\n \n"), (63, f"\n\n{notice}\n"), (63, f"\n\n{notice}\n"), (64, "\n".join([words(rng, 60000, "aeinorst"), notice, words(rng, 60000, "aeinorst")]))]
    got = [(r["doc_id"], r["paragraph"], r["family"]) for r in license.scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(63, 2, "mit"), (63, 2, "mit"), (64, 1, "mit")]


def test_licence_calibration_uses_unseen_wordings():
    model = license.fit([*license.variants(__import__("numpy").random.default_rng(3), license.TEMPLATES, 8), *[(w, license.UNKNOWN) for w in ("plain words here", "more of the same text")]], steps=20)
    sure = [(license.TEMPLATES["mit"][0], "mit"), (license.TEMPLATES["bsl-1.0"][0], "bsl-1.0")]
    wrong = [(license.TEMPLATES["mit"][0], "isc"), (license.TEMPLATES["zlib"][0], "bsl-1.0")]
    assert license.temperature(model, sure) < license.temperature(model, wrong)
    assert license.temperature(model, []) == 1.0


def test_quality_with_repeated_ids_is_the_same_again(spark):
    """Of texts that share a labelled id one is learned from, the same in reruns and however rows are dealt."""
    rng = random.Random(10)
    rows = [(3 * i % 90, ("!! " if i % 2 else "") + words(rng, 20)) for i in range(200)]
    lab = spark.createDataFrame([(3 * i % 90, i % 2) for i in range(30)], "doc_id long, quality int")
    key = lambda n: sorted((r["doc_id"], r["score"]) for r in quality.score_quality(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(n), lab, rows=20).collect())
    assert key(2) == key(5)
