import random
import re
from collections import Counter, defaultdict

from made import words

from quillspark.llm import neardup
from quillspark.llm.common import components


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute(rows):
    """Component of each text by comparing all pairs that share a shingle."""
    texts = sorted({t or "" for _, t in rows})
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            lists[x].append(i)
    for i, s in enumerate(sets):
        for j, same in Counter(j for x in s for j in lists[x] if j < i).items():
            if 100 * same >= 85 * (len(s) + len(sets[j]) - same):
                up[top(i)] = top(j)
    at = {t: i for i, t in enumerate(texts)}
    least = {}
    for d, t in rows:
        if d is not None and sets[at[t or ""]]:
            k = top(at[t or ""])
            least[k] = min(least.get(k, d), d)
    return [(d, len(sets[at[t or ""]]), least.get(top(at[t or ""])) if sets[at[t or ""]] else d) for d, t in rows]


def check(spark, df, rows):
    got = [tuple(r) for r in neardup.near_duplicate_groups(spark, df).collect()]
    want = [(*w, w[0] is not None and w[0] == w[2]) for w in brute(rows)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_same_groups_as_brute_force(spark, docs, rows):
    check(spark, docs, [(r[0], r[1]) for r in rows])


def test_large_near_copy_group_with_stragglers(spark):
    """Copies edited little link through a template; those edited much must stay out, or in if one other is near."""
    rng = random.Random(1)
    base = words(rng, 150).split()
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(200 + k, rows[k][1].rsplit(" ", 2)[0]) for k in range(0, 150, 7)]
    passage = words(rng, 60)
    rows += [(400 + k, words(rng, 60) + " " + passage) for k in range(60)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_keeps_one_of_each_group(spark, docs, rows):
    kept = neardup.without_near_duplicates(spark, docs)
    assert kept.columns == docs.columns
    want = {d for d, _, c in brute([(r[0], r[1]) for r in rows]) if d is not None and d == c}
    got = [r[0] for r in kept.select("doc_id").collect() if r[0] is not None]
    assert sorted(got) == sorted(want)


def test_empty_table(spark, empty):
    assert neardup.near_duplicate_groups(spark, empty).collect() == []


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {x: x for e in edges for x in e}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(spark, spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}
