"""Licence notices in paragraphs: a trained classifier proposes a family, comparison with its templates confirms it.

Features are hashed words and word pairs, as in the quality classifier, but as written, since versions and abbreviations
tell families apart. A softmax regression over the families and ``unknown`` is trained on variants of the templates (cut,
with words dropped or added) against lines of the corpus of 20 to 2,000 characters, at most ``NEGATIVES`` of them, from
as many documents, those with the smallest hashes, that share no telling word with any template. A temperature
calibrates the probabilities; it is fitted on wordings and lines that a first model hasn't seen: of each family with
several templates one is held out. A text whose best class is a family, by at least ``MIN_CHANCE``, is compared with that
family's templates: it must hold ``CONFIRM`` of the word pairs of one. Every line of every whole text is scored.

A notice inside a longer line would be diluted there, and one that is wrapped is on no line as a whole. So spans of every
paragraph, a run of lines that aren't blank, are scored as well: wherever the words of one and a half times a template's
length hold over half of its word pairs, the span of those pairs. Longer matches come first, and spans that overlap a
found one are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Powers, bounded_sample, ensure_importable
from .quality import features

BITS = 16
NEGATIVES, VARIANTS = 3000, 60
MIN_CHANCE, CONFIRM = 0.5, 0.5
UNKNOWN = "unknown"

# Wordings in which these licences are named or granted.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.", "either version 2 of the License, or (at your option) any later version of the GNU General Public License"),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "agpl-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "isc": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "bsl-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "zlib": ("Licensed under the zlib License.", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    "epl-2.0": ("Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "proprietary": ("All rights reserved.", "This software is confidential and proprietary; unauthorized copying of this file is strictly prohibited."),
}
_CUES = r"(?i)licen[sc]|copyright|permission|warrant|redistribut|creative commons|rights reserved|public domain"


def tokens(text: str) -> list[str]:
    return re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)*", text.lower())


def _pairs(text: str) -> set[tuple[str, str]]:
    t = tokens(text)
    return set(zip(t, t[1:])) or {(x, "") for x in t}


_TEMPLATE_PAIRS = {family: [_pairs(t) for t in texts] for family, texts in TEMPLATES.items()}


def similarity(text: str, family: str) -> float:
    """The largest share of a template's word pairs that the text holds; of the text's own if it is the shorter."""
    own = _pairs(text)
    best = 0.0
    for pairs in _TEMPLATE_PAIRS[family]:
        same = len(own & pairs)
        best = max(best, same / len(pairs), same / max(len(own), 4) if len(own) < len(pairs) else 0.0)
    return best


_ENDS = [(pairs, int(1.5 * len(tokens(t))) + 4) for family, texts in TEMPLATES.items() for t, pairs in zip(texts, _TEMPLATE_PAIRS[family])]
_OWNERS: dict[tuple[str, str], list[int]] = {}
for _i, (_p, _) in enumerate(_ENDS):
    for _x in _p:
        _OWNERS.setdefault(_x, []).append(_i)


def spans(text: str) -> list[tuple[int, int, int, str]]:
    """First word, end word, first character and text of the spans that hold over half of a template's word pairs, best matches first."""
    low = text.lower()
    words = tokens(low)
    places: dict[int, list[tuple[int, tuple[str, str]]]] = {}
    for i, pair in enumerate(zip(words, words[1:])):
        for k in _OWNERS.get(pair, ()):
            places.setdefault(k, []).append((i, pair))
    found: dict[tuple[int, int], int] = {}
    for k, own in places.items():
        pairs, reach = _ENDS[k]
        j = 0
        while j < len(own):
            near = [x for x in own[j : j + reach] if x[0] < own[j][0] + reach]
            same = len({p for _, p in near})
            if 2 * same > len(pairs):
                key = (near[0][0], near[-1][0] + 2)
                found[key] = max(found.get(key, 0), same)
            j += 1
    if not found:
        return []
    source = text if len(low) == len(text) else low
    at = [m.span() for m in re.finditer(r"[a-z]+|[0-9]+(?:\.[0-9]+)*", low)]
    ranked = sorted(found, key=lambda x: (-found[x], x[1] - x[0], x))
    return [(a, z, at[a][0], source[at[a][0] : at[z - 1][1]]) for a, z in ranked]


def variants(rng: np.random.Generator, templates: dict[str, tuple[str, ...]], n: int = VARIANTS) -> list[tuple[str, str]]:
    out = []
    filler = ["project", "file", "code", "see", "for", "details", "terms", "here", "copyright", "2020", "inc", "authors"]
    for family, texts in templates.items():
        for t in texts:
            words = t.split()
            out += [(t, family), (t.upper(), family), (t.rstrip("."), family)]
            for _ in range(n // len(texts)):
                w = list(words)
                if len(w) > 8 and rng.random() < 0.5:
                    at = int(rng.integers(0, len(w) - 6))
                    w = w[at:] if rng.random() < 0.5 else w[: at + 6]
                if len(w) > 6:
                    w = [x for x in w if rng.random() > 0.08]
                for _ in range(int(rng.integers(0, 5))):
                    w.insert(0 if rng.random() < 0.5 else len(w), filler[int(rng.integers(0, len(filler)))])
                out.append((" ".join(w), family))
    return out


def _sparse(texts: list[str], powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, places, values = [], [], []
    for lo, _, owner, place, value in features(pa.array(texts, pa.string()), powers, BITS, False):
        rows.append(owner + lo)
        places.append(place)
        values.append(value)
    return np.concatenate(rows), np.concatenate(places), np.concatenate(values)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(examples: list[tuple[str, str]], steps: int = 120, rate: float = 1.5, momentum: float = 0.9, decay: float = 1e-4) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Classes, weights (places by classes) and bias; classes weigh the same, whatever their number of examples."""
    classes = [*TEMPLATES, UNKNOWN]
    row, place, value = _sparse([t for t, _ in examples], Powers())
    y = np.array([classes.index(c) for _, c in examples])
    size = np.bincount(y, minlength=len(classes))
    share = 1 / np.maximum(size, 1)[y]
    share /= share.sum()
    live, back = np.unique(place, return_inverse=True)
    w, bias = np.zeros((live.size, len(classes))), np.zeros(len(classes))
    dw, db = np.zeros_like(w), np.zeros_like(bias)
    target = np.eye(len(classes))[y]
    for _ in range(steps):
        z = np.stack([np.bincount(row, weights=value * w[back, c], minlength=len(examples)) + bias[c] for c in range(len(classes))], axis=1)
        g = (target - _softmax(z)) * share[:, None]
        for c in range(len(classes)):
            dw[:, c] = momentum * dw[:, c] + rate * len(classes) * np.bincount(back, weights=value * g[row, c], minlength=live.size) - decay * w[:, c]
        db = momentum * db + rate * g.sum(axis=0)
        w += dw
        bias += db
    whole = np.zeros((1 << BITS, len(classes)))
    whole[live] = w
    return classes, whole, bias


def temperature(model: tuple[list[str], np.ndarray, np.ndarray], held: list[tuple[str, str]]) -> float:
    """What the logits have to be divided by to be likeliest on held-out examples; classes weigh the same."""
    classes, weights, bias = model
    if not held:
        return 1.0
    row, place, value = _sparse([t for t, _ in held], Powers())
    z = np.stack([np.bincount(row, weights=value * weights[place, c], minlength=len(held)) + bias[c] for c in range(len(classes))], axis=1)
    y = np.array([classes.index(c) for _, c in held])
    share = 1 / np.bincount(y, minlength=len(classes))[y]
    heats = np.geomspace(0.2, 5, 33)
    loss = [-(share * np.log(np.maximum(_softmax(z / t)[np.arange(len(held)), y], 1e-12))).sum() for t in heats]
    return float(heats[int(np.argmin(loss))])


def train(docs: DataFrame, id_col: str, text_col: str, negatives: int = NEGATIVES) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    some = bounded_sample(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "id", negatives)
    lines = some.select(F.explode(F.split("text", "\n")).alias("line")).where("length(line) between 20 and 2000").where(~F.col("line").rlike(_CUES))
    drawn = [r["line"] for r in bounded_sample(lines.distinct(), "line", negatives).collect()]
    plain = ["the quick report was read by the team", "see the table of results for details", "version 3 of the work was under review", "a copy of this file"]
    unknown = [(t, UNKNOWN) for t in drawn + plain]
    seen = {f: t[:-1] if len(t) > 1 else t for f, t in TEMPLATES.items()}
    unseen = {f: t[-1:] for f, t in TEMPLATES.items() if len(t) > 1}
    first = fit(variants(np.random.default_rng(3), seen) + unknown[::2])
    heat = temperature(first, variants(np.random.default_rng(4), unseen) + unknown[1::2])
    return (*fit(variants(np.random.default_rng(3), TEMPLATES) + unknown), heat)


def paragraphs(lines: list[str], doc: np.ndarray) -> Iterator[tuple[int, list[str]]]:
    """Place of the first line and lines of every run of lines of one document that aren't blank."""
    head, block = 0, []
    for i, line in enumerate(lines):
        if block and (not line.strip() or doc[i] != doc[head]):
            yield head, block
            block = []
        if line.strip():
            if not block:
                head = i
            block.append(line)
    if block:
        yield head, block


def scan_licenses(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chance: float = MIN_CHANCE, confirm: float = CONFIRM) -> DataFrame:
    """``doc_id, paragraph, family, score, similarity``, one row for each line and family with a confirmed licence notice
    that is on it or begins on it.

    paragraph counts lines from 0, blank ones too. Null and empty texts have none. Long texts are read whole. Repeated
    rows give repeated findings; an empty table gives none. Other columns are ignored, whatever their names.
    """
    ensure_importable(spark)
    shared = spark.sparkContext.broadcast(train(docs, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, weights, bias, heat = shared.value
        live = np.flatnonzero(np.abs(weights).max(axis=1) > 1e-6)
        spot = np.full(1 << BITS, -1, np.int64)
        spot[live] = np.arange(live.size)
        table = weights[live]
        powers = Powers()

        def judged(lines: pa.Array) -> Iterator[tuple[int, str, float, float]]:
            for lo, hi, owner, place, value in features(lines, powers, BITS, False):
                known = spot[place] >= 0
                owner, place, value = owner[known], spot[place[known]], value[known]
                z = np.stack([np.bincount(owner, weights=value * table[place, c], minlength=hi - lo) + bias[c] for c in range(len(classes))], axis=1) / heat
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(axis=1, keepdims=True)
                top = p.argmax(axis=1)
                for i in np.flatnonzero((top < len(classes) - 1) & (p.max(axis=1) >= min_chance)).tolist():
                    like = similarity(lines[lo + i].as_py(), family := classes[top[i]])
                    if like >= confirm:
                        yield lo + i, family, float(p[i, top[i]]), like

        for big in batches:
            for at in range(0, big.num_rows, 1024):
                b = big.slice(at, 1024)
                split = pc.split_pattern(pc.fill_null(b.column(1), ""), "\n")
                lines = split.flatten()
                doc = pc.list_parent_indices(split).to_numpy()
                first = np.r_[0, np.cumsum(np.bincount(doc, minlength=b.num_rows))]
                whole = {i: (family, chance, like) for i, family, chance, like in judged(lines)}
                out = [(i, *found) for i, found in whole.items()]
                owner, parts = [], []
                for n, (head, block) in enumerate(paragraphs(lines.to_pylist(), doc)):
                    starts = np.cumsum([0, *(len(x) + 1 for x in block)])
                    for a, z, at_char, part in spans("\n".join(block)):
                        owner.append((n, head + int(np.searchsorted(starts, at_char, "right")) - 1))
                        parts.append((a, z, part))
                taken: dict[int, list[tuple[int, int]]] = {}
                begun: dict[int, int] = {}
                families = {i: {found[0]} for i, found in whole.items()}
                for j, family, chance, like in sorted(judged(pa.array([t for _, _, t in parts], pa.string()))):
                    (n, i), (first_word, end_word, _) = owner[j], parts[j]
                    if like > 0.5 and all(end_word <= x or first_word >= y for x, y in taken.get(n, ())):
                        taken.setdefault(n, []).append((first_word, end_word))
                        begun[i] = begun.get(i, 0) + 1
                        if i not in whole or begun[i] > 1:  # the first is the notice that the line as a whole showed
                            if family not in families.setdefault(i, set()):
                                families[i].add(family)
                                out.append((i, family, chance, like))
                out = [(b.column(0)[int(doc[i])].as_py(), i - int(first[doc[i]]), family, chance, like) for i, family, chance, like in out]
                columns = list(zip(*out)) or [(), (), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()))], names=["doc_id", "paragraph", "family", "score", "similarity"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, paragraph long, family string, score double, similarity double")
