"""Document quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

A text is split into words and runs of punctuation. Words are folded to lower case; one in capitals throughout becomes
a mark for capitals, and one equal to the word before it a mark for repetition, since what such words have in common is
their shape. Features are single tokens and pairs of neighbours, hashed to ``2**BITS`` places, weighed by the root of
their counts and normed to length 1; a score is the logistic of one sparse dot product with the weights.

Training is bounded: at most ``TRAIN_ROWS`` labelled ids, those with the smallest hashes, one text each, of which the
driver gets the hashed features, all of them. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _MULT, _STEP, BYTES_FOLDED, Powers, bounded_sample, ensure_importable, mix64, span_hashes, text_chunks
from .langid import held_out

BITS = 18
TRAIN_ROWS, EPOCHS = 6000, 4
ALPHA, BETA, L1, L2 = 0.4, 1.0, 1e-4, 1e-4
THRESHOLD = 0.7

_KIND = np.full(256, 1, np.uint8)  # 0 white space and controls, 1 letters, 2 digits, 3 punctuation
_KIND[:33] = 0
_KIND[48:58] = 2
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 128)):
    _KIND[_a:_b] = 3
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_CAPITALS, _REPEAT, _NUMBER = (mix64(np.array([n], np.uint64) * _MULT)[0] for n in (11, 12, 13))


def features(texts: pa.Array, powers: Powers, bits: int = BITS, marks: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, end row, and row, place and value of every feature.

    With ``marks``, capitals, repetitions and numbers stand for the words they are; without, words stand for themselves.
    """
    for lo, hi, data, offs in text_chunks(texts):
        rows = hi - lo
        if not data.size:
            none = np.zeros(0, np.int64)
            yield lo, hi, none, none, np.zeros(0)
            continue
        kind = _KIND[data]
        new = np.ones(data.size, bool)
        new[1:] = kind[1:] != kind[:-1]
        new[offs[:-1][offs[:-1] < offs[1:]]] = True
        at = np.flatnonzero(new)
        to = np.r_[at[1:], data.size]
        full = kind[at] != 0
        at, to = at[full], to[full]
        if not at.size:
            none = np.zeros(0, np.int64)
            yield lo, hi, none, none, np.zeros(0)
            continue
        row = np.searchsorted(offs, at, "right") - 1
        h = span_hashes(data, at, to, BYTES_FOLDED, powers)
        word = kind[at] == 1
        capitals = np.r_[0, np.cumsum(_CAPITAL[data])]
        small = np.r_[0, np.cumsum(_SMALL[data])]
        shout = word & (capitals[to] - capitals[at] >= 2) & (small[to] == small[at])
        # The token before is the repeated word, whatever mark it got itself.
        again = np.zeros(at.size, bool)
        again[1:] = word[1:] & (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        token = np.where(again, _REPEAT, np.where(shout, _CAPITALS, np.where(kind[at] == 2, _NUMBER, h))) if marks else h
        pair = mix64(token[:-1] * _STEP + token[1:])[row[1:] == row[:-1]]
        places = np.concatenate([token, pair]) & np.uint64((1 << bits) - 1)
        owner = np.concatenate([row, row[1:][row[1:] == row[:-1]]])
        key, count = np.unique(owner.astype(np.int64) << bits | places.astype(np.int64), return_counts=True)
        owner, place, value = key >> bits, key & ((1 << bits) - 1), np.sqrt(count)
        norm = np.sqrt(np.bincount(owner, weights=value * value, minlength=rows))
        yield lo, hi, owner, place, value / norm[owner]


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the bias last, by per-coordinate follow-the-regularised-leader; classes weigh the same."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    ones = labels.mean() if labels.size else 0.5
    weigh = {1: 0.5 / max(ones, 1e-9), 0: 0.5 / max(1 - ones, 1e-9)}

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= L1, 0.0, (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            i, x = np.append(rows[r][0].astype(np.int64), size - 1), np.append(rows[r][1].astype(float), 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - labels[r]) * weigh[int(labels[r])] * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(size))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, bits: int = BITS) -> np.ndarray | None:
    """Weights from labelled rows that aren't held out; None unless both labels occur."""
    ensure_importable(spark)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(~held_out("id") & F.col("y").isin(0, 1))
    chosen = bounded_sample(marked.groupBy("id").agg(F.max("y").alias("y")), "id", rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            for lo, hi, owner, place, value in features(b.column(1), powers, bits):
                cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                places = [place[a:z].astype("<i4").tobytes() for a, z in zip(cut[:-1], cut[1:])]
                values = [value[a:z].astype("<f4").tobytes() for a, z in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["y", "k", "places", "values"])

    met = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("_id") == F.col("id"))
    # Of texts that share an id, the one with the smallest hash; so what comes back is bounded and the same in reruns.
    one = met.select("id", "y", "text", F.xxhash64("id", "text").alias("k")).groupBy("id").agg(F.min_by(F.struct("y", "text", "k"), F.struct("k", "text")).alias("r"))
    got = one.select("r.y", "r.text", "r.k").mapInArrow(run, "y int, k long, places binary, values binary").collect()
    got.sort(key=lambda r: (r["k"], r["places"]))
    y = np.array([r["y"] for r in got])
    if len(set(y.tolist())) < 2:
        return None
    return train_ftrl([(np.frombuffer(r["places"], "<i4"), np.frombuffer(r["values"], "<f4")) for r in got], y, bits)


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, bits: int = BITS, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row for each row of ``docs``.

    Labels are learned from rows that aren't held out (crc32 of the id as text, modulo 4, is 2); a score depends on the
    text alone. Null and empty texts score what the bias gives. Without rows of both labels every score is 0.5. Rows
    with a null id are never held out; ids labelled twice count once, as the better. Other columns are ignored.
    """
    ensure_importable(spark)
    weights = train(spark, docs, labels, id_col, text_col, label_col, bits=bits, **options)
    shared = spark.sparkContext.broadcast(np.zeros((1 << bits) + 1) if weights is None else weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, w = Powers(), shared.value
        for b in batches:
            for lo, hi, owner, place, value in features(b.column(1), powers, bits):
                dot = np.bincount(owner, weights=value * w[place], minlength=hi - lo) + w[-1]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(dot, -30, 30))))], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
