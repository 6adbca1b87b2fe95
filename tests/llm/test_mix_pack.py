import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillspark.llm import mixing, packing

PATH = None


def test_targets_stop_at_twice_the_size_and_reshare():
    assert mixing.targets([100, 100, 100]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert sum(mixing.targets([5, 1000, 30, 7])) == pytest.approx(1.5 * 1042)
    assert mixing.targets([0, 0]) == [0.0, 0.0]
    assert mixing.targets([]) == []


def test_mix_against_brute_force(spark, docs, rows):
    import hashlib

    got = mixing.mix_sources(spark, docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    by = defaultdict(list)
    for d, t, _, s, _ in rows:
        by[s].append((int(hashlib.md5(str("" if d is None else d).encode()).hexdigest()[:13], 16), size(t), d))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    goal = dict(zip(order, mixing.targets([sum(x[1] for x in by[s]) for s in order])))
    want = []
    for s in order:
        total = sum(x[1] for x in by[s])
        passes = min(2, int(goal[s] // total)) if total else 0
        rest, below = goal[s] - passes * total, 0
        for h in sorted({x[0] for x in by[s]}):
            unit = [x for x in by[s] if x[0] == h]
            n = sum(x[1] for x in unit)
            extra = rest > 0 and 2 * below + n <= 2 * rest
            want += [(d, z, total, goal[s], z * (passes + extra), s) for _, z, d in unit]
            below += n
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_mixed_documents_repeat_as_planned(spark, docs):
    plan = {}
    for r in mixing.mix_sources(spark, docs).collect():
        if r["size"]:
            plan[r["doc_id"]] = r["taken"] // r["size"]
    mixed = mixing.mixed_documents(spark, docs)
    assert mixed.columns == docs.columns
    seen = defaultdict(int)
    for r in mixed.select("doc_id").collect():
        seen[r[0]] += 1
    rows = {r[0]: r[1] for r in docs.groupBy("doc_id").count().collect()}
    assert all(seen[d] == n * rows[d] for d, n in plan.items())


def test_mix_of_nothing(spark, empty):
    assert mixing.mix_sources(spark, empty).collect() == []


def token_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_quick_pieces_equal_the_tokenizer():
    texts = ["a  b\n\nc", " lead", "trail  ", "don't we'll I'M 'sx '' ' s", "x'd'll\tq", "1a2b 33 é½²x", "a  b c", "\n \n x", "it's\n'twas", "  ", "a" * 3000, "£$%^ &*'re'", "Ünïcodé ªºŉ", "<|endoftext|>", "漢字 mixed", "tab\t\tx \t y", "'ll", "x 've", "'s's's", "a'", "'"]
    tokens = packing.Tokens(packing.tokenizer_path())
    for _ in range(2):  # learned, then kept
        assert [x.tolist() for x in tokens.ids(texts)] == token_ids(texts)


def test_quick_pieces_on_random_text():
    rng = np.random.default_rng(2)
    marks = list("abzABZ019 '\n\t.,-sdmtrveléß ") + ["'s", "'re", "  ", "\r\n"]
    texts = ["".join(rng.choice(marks, rng.integers(1, 60))) for _ in range(1500)]
    tokens = packing.Tokens(packing.tokenizer_path())
    assert [x.tolist() for x in tokens.ids(texts)] == token_ids(texts)


def test_ids_of_every_code_point():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}1{c}!{c}\n{c}  {c}z" for c in every[i : i + 2000]) for i in range(0, len(every), 2000)]
    tokens = packing.Tokens(packing.tokenizer_path())
    assert tokens.ranked is not None
    assert [x.tolist() for x in tokens.ids(texts)] == token_ids(texts)


def test_other_tokenizer_files_go_to_the_library(tmp_path):
    """A file that splits or merges in another way has no merger by rank."""
    import json

    with open(packing.tokenizer_path(), encoding="utf-8") as f:
        file = json.load(f)
    for k, change in enumerate(({"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": file["pre_tokenizer"] | {"add_prefix_space": True}})):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(file | change), encoding="utf-8")
        tokens = packing.Tokens(str(path))
        assert tokens.ranked is None
        assert [x.tolist() for x in tokens.ids(["It's ON  now"])] == [tokens.tokenizer.encode("It's ON  now", add_special_tokens=False).ids]


@pytest.mark.parametrize("seed", [1, 2])
def test_plan_places_all_tails_without_padding(seed):
    """Most of an even histogram goes into whole windows, and every rank of every length has one place."""
    h = np.random.default_rng(seed).integers(0, 40, 128)
    plan = packing.make_plan(h, 128)
    assert plan.laid <= 0.3 * (h * np.arange(128)).sum()
    placed = np.zeros(128, np.int64)
    full: dict[int, int] = defaultdict(int)
    for key, stop, sequence in zip(plan.key.tolist(), plan.stop.tolist(), plan.sequence.tolist()):
        placed[key >> 44] += stop - key
        for s in range(sequence, sequence + stop - key):
            full[s] += key >> 44
    assert set(full.values()) == {128} and sorted(full) == list(range(plan.laid_from))
    assert (placed == plan.from_rank).all() and ((h - placed)[1:] >= 0).all()
    assert plan.laid == ((h - placed) * np.arange(128)).sum()


@pytest.mark.parametrize("window", [16, 1024])
def test_every_id_in_one_piece(spark, docs, rows, window):
    ids = [np.array([*x, 0], "<u4") for x in token_ids([r[1] or "" for r in rows])]
    by = defaultdict(list)
    for r, x in zip(rows, ids):
        by[r[0]].append(x)
    pieces = packing.pack_sequences(spark, docs, window=window).collect()
    found = defaultdict(list)
    for p in pieces:
        found[p["doc_id"]].append(p)
    assert set(found) == set(by)
    for d, own in found.items():
        want = sorted((s["start"], s["length"]) for s in own)
        assert sum(n for _, n in want) == sum(len(x) for x in by[d])
        assert len(by[d]) > 1 or [s for s, _ in want] == np.r_[0, np.cumsum([n for _, n in want])[:-1]].tolist()
        for p in own:
            assert any(p["doc_tokens"] == len(x) and zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for x in by[d])
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == window or (at < window and at & (at - 1) == 0)
    assert sum(sum(n for _, n in s) < window for s in sequences.values()) <= window.bit_length()


def test_plan_uses_combinations():
    h = np.zeros(64, np.int64)
    h[[10, 54, 20, 34, 7]] = [80, 50, 30, 30, 11]
    plan = packing.make_plan(h, 64)
    assert plan.laid == 77
    combos = packing.combinations(h, 64)
    assert {tuple(c) for c in combos} >= {(10, 54, 0), (10, 20, 34)}
    assert (packing.repeat_counts(h, combos) >= 0).all()


def test_packing_nothing(spark, empty):
    assert packing.pack_sequences(spark, empty).collect() == []
