import random

from made import words
from test_near_duplicates import shingles

from quillspark.llm import neardup


def grown(num, least=49, most=60, times=12):
    """Pairs of 48 shingles and of 49 to 60: the larger set exceeds the sketch."""
    rng = random.Random(num)
    rows = []
    for m in range(least, most + 1):
        for _ in range(times):
            w = words(rng, 48 + 4)
            rows += [(len(rows), w), (len(rows) + 1, w + " " + words(rng, m - 48))]
    return rows


def linked(a, b, num):
    a, b = shingles(a), shingles(b)
    return 100 * len(a & b) >= num * len(a | b)


def pairs_kept_apart(rows, num):
    return {(rows[i][0], rows[i + 1][0]) for i in range(0, len(rows), 2) if not linked(rows[i][1], rows[i + 1][1], num)}


def test_sets_just_over_the_sketch(spark):
    for num in (85, 80):
        rows = grown(num)
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicate_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"), numerator=num).collect()}
        apart = {(a, a + 1) for a in range(0, len(rows), 2) if got[a] != got[a + 1]}
        assert apart == pairs_kept_apart(rows, num)


def test_drops_copies_of_080(spark):
    """Pairs of likeness 0.80 to 0.85 among others, against brute force."""
    rng = random.Random(8)
    rows = grown(8, 49, 62, 3)
    for _ in range(40):
        n = rng.randint(40, 300)
        w = words(rng, n)
        rows += [(len(rows), w), (len(rows) + 1, " ".join(w.split() + words(rng, int(n * rng.uniform(0.1, 0.35))).split()))]
    between = [i for i in range(0, len(rows), 2) if linked(rows[i][1], rows[i + 1][1], 80) and not linked(rows[i][1], rows[i + 1][1], 85)]
    assert len(between) > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {a for a, _ in rows[::2]} | {b for _, b in pairs_kept_apart(rows, 80)}
    assert {r["doc_id"] for r in neardup.without_near_duplicates(spark, docs, numerator=80, slack=0.3).collect()} == want
