"""Language identification with a blended-spectrum string kernel, Nyström landmarks and kernel ridge regression.

A text's features are which character n-grams (1 to ``MAX_N``) it holds: presence, not counts. The kernel of two texts
is the number of n-grams that both hold, over the root of the product of their set sizes. Landmarks are training texts;
only their n-grams enter any kernel value with a landmark, so the vocabulary is theirs. Nyström features are
``K(x, landmarks) K(landmarks, landmarks)^-1/2``; one ridge regression for each language runs on them, one versus rest.

Scoring is linear in the presence vector apart from its norm. The product of landmark presence, inverse root and ridge
weights is therefore folded once into one vocabulary-by-languages matrix, and a block of texts is scored by a single
matrix product of its presence rows with that matrix.

Training is bounded by parameters: ``LANDMARKS`` and ``TRAIN`` texts a language, chosen by the smallest hashes of their
ids, each read in a window of ``TRAIN_CHARS`` characters that begins at a place drawn by that hash; with many languages
each has fewer landmarks, ``ALL_LANDMARKS`` in all (two at least). Every language is learned; the driver holds that much
for each, so more than ``MAX_LANGUAGES`` are an error. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from .common import ensure_importable

MAX_N = 4
LANDMARKS, TRAIN, TRAIN_CHARS = 64, 400, 4000
RIDGE = 0.05
#: Landmarks of all languages together; and the languages beyond which training stops with an error.
ALL_LANDMARKS, MAX_LANGUAGES = 512, 256
UNDETERMINED = "und"
#: Slots of the table from n-gram hashes to the vocabulary.
SLOTS = 1 << 21
BLOCK_CHARS, BLOCK_ROWS = 1 << 18, 64


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _letters(kinds: str) -> np.ndarray:
    """Which code points are letters (L) or marks on them (M)."""
    import unicodedata

    return np.array([unicodedata.category(chr(c))[0] in kinds for c in range(0x3000)], bool)


class Grams:
    """Turns texts into slots of their n-grams."""

    def __init__(self) -> None:
        self.letter, self.part = _letters("L"), _letters("LM")

    def is_letter(self, cp: np.ndarray, table: np.ndarray) -> np.ndarray:
        low = cp < table.size
        out = np.zeros(cp.size, bool)
        out[low] = table[cp[low]]
        if not low.all():  # beyond the table, Python's own test
            far, back = np.unique(cp[~low], return_inverse=True)
            out[~low] = np.array([chr(c).isalpha() if c < 0xD800 or c > 0xDFFF else False for c in far.tolist()], bool)[back]
        return out

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and slot of every n-gram of letters and single separators; and whether a row has a letter."""
        low = [t.lower() for t in texts]
        size = np.array([len(t) for t in low], np.int64)
        cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(texts)), size)
        has = np.bincount(row[self.is_letter(cp, self.letter)], minlength=len(texts)) > 0
        letter = self.is_letter(cp, self.part)
        cp = np.where(letter, cp, np.uint32(32))
        keep = letter.copy()  # one separator for each run of others
        keep[1:] |= ~letter[1:] & letter[:-1]
        cp, row = cp[keep], row[keep]
        rows, slots = [], []
        h = np.zeros(cp.size, np.uint32)
        for n in range(1, MAX_N + 1):
            end = cp.size - n + 1
            if end <= 0:
                break
            h = h[:end] * np.uint32(0x01000193) + (cp[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
            x = h ^ (h >> np.uint32(15))
            x = x * np.uint32(0x85EBCA77) + np.uint32(n)
            x ^= x >> np.uint32(13)
            same = row[:end] == row[n - 1 :]
            rows.append(row[:end][same])
            slots.append((x[same] % np.uint32(SLOTS)).astype(np.int64))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), has
        return np.concatenate(rows), np.concatenate(slots), has


@dataclass
class Model:
    """``slot``: vocabulary place of each hash slot, or -1. ``weights``: vocabulary by languages."""

    languages: list[str]
    slot: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, presence: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(presence.sum(axis=1, keepdims=True), 1))
        return (presence @ self.weights) / norm + self.bias


def _presence(grams: Grams, slot: np.ndarray, width: int, texts: list[str], out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    rows, slots, has = grams.of(texts)
    place = slot[slots]
    known = place >= 0
    if out is None:
        out = np.zeros((len(texts), width), np.float32)
    else:
        out[: len(texts)] = 0
        out = out[: len(texts)]
    out[rows[known], place[known]] = 1
    return out, has


def fit(landmarks: list[str], texts: list[str], labels: list[str], ridge: float = RIDGE) -> Model:
    """Train on given texts; languages are the labels found, in code point order."""
    languages = sorted(set(labels))
    grams = Grams()
    _, slots, _ = grams.of(landmarks)
    vocabulary = np.unique(slots)
    slot = np.full(SLOTS, -1, np.int32)
    slot[vocabulary] = np.arange(vocabulary.size)
    width = max(1, vocabulary.size)

    def normed(block: list[str]) -> np.ndarray:
        p, _ = _presence(grams, slot, width, block)
        p /= np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))
        return p

    def blocks(all_: list[str]) -> list[list[str]]:
        return [all_[i : i + BLOCK_ROWS] for i in range(0, len(all_), BLOCK_ROWS)]

    marks = normed(landmarks)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-8 * max(values.max(initial=0), 1e-300)
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.concatenate([normed(b) @ marks.T for b in blocks(texts)]).astype(np.float64) @ root
    y = np.array([[1.0 if x == c else 0.0 for c in languages] for x in labels])
    # Each language weighs the same, whatever its number of texts.
    weight = (1 / y.sum(axis=0))[[languages.index(x) for x in labels]]
    weight /= weight.mean()
    mean = (weight[:, None] * phi).sum(axis=0) / weight.sum()
    base = (weight[:, None] * y).sum(axis=0) / weight.sum()
    x = phi - mean
    gram = x.T @ (weight[:, None] * x) + ridge * len(texts) * np.eye(x.shape[1]) * 1e-2
    ridge_weights = np.linalg.solve(gram, x.T @ (weight[:, None] * (y - base)))
    return Model(languages, slot, marks.T @ (root @ ridge_weights).astype(np.float32), (base - mean @ ridge_weights).astype(np.float32))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", landmarks: int = LANDMARKS, per_language: int = TRAIN) -> Model | None:
    """A model from the rows that aren't held out and have text and language; None if there are none.

    Two passes over the table, however many languages there are: one counts, one draws by hash thresholds.
    """
    known = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    landmarks = max(2, min(landmarks, ALL_LANDMARKS // len(counts)))
    need = landmarks + per_language
    top = 1 << 40
    share = known.sparkSession.createDataFrame([(c, top if n <= 2 * need + 200 else int(top * (2 * need + 200) / n)) for c, n in sorted(counts.items())], "_lang string, _upto long")
    place = F.pmod(F.xxhash64("id", "text"), F.lit(top))
    near = known.withColumn("_place", place).join(F.broadcast(share), F.col("lang") == F.col("_lang")).where("_place < _upto")
    window = F.substring(F.col("text"), (F.col("_place") % F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1)) + 1).cast("int"), F.lit(TRAIN_CHARS))
    drawn = near.select("lang", "_place", window.alias("text")).withColumn("_turn", F.row_number().over(W.partitionBy("lang").orderBy("_place", "text"))).where(F.col("_turn") <= need)
    texts: dict[str, list[str]] = {}
    for r in sorted(drawn.select("lang", "_place", "text").collect(), key=lambda r: (r["lang"].encode(), r["_place"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    picked = [(t, lang) for lang, own in texts.items() for t in (own[landmarks:] or own)]
    # Long texts are long evidence; shorter cuts of them show the model what little text looks like.
    cuts = [(t[: 40 + (7919 * i) % 400], lang) for i, (t, lang) in enumerate(picked) if len(t) > 480]
    both = picked + cuts
    return fit([t for own in texts.values() for t in own[:landmarks]], [t for t, _ in both], [c for _, c in both])


def predicted(spark: SparkSession, text: Column, model: Model | None) -> Column:
    """A struct ``lang_pred, score`` for a text; of the row, only the text goes to Python.

    Null and letterless texts get ``und`` and 0, and so does every text without a model.
    """
    ensure_importable(spark)
    if model is None:
        return F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        grams = Grams()
        room = np.zeros((BLOCK_ROWS, m.weights.shape[0]), np.float32)
        names = np.array([*m.languages, UNDETERMINED], object)
        for column in columns:
            best, score = np.zeros(len(column), np.int64), np.zeros(len(column))
            for lo in range(0, len(column), BLOCK_ROWS):
                texts = [t if t is not None else "" for t in column.slice(lo, BLOCK_ROWS).to_pylist()]
                at = 0
                while at < len(texts):
                    end, chars = at + 1, len(texts[at])
                    while end < len(texts) and chars + len(texts[end]) <= BLOCK_CHARS:
                        chars += len(texts[end])
                        end += 1
                    p, has = _presence(grams, m.slot, m.weights.shape[0], texts[at:end], room)
                    s = np.clip(m.scores(p), 0, 1).astype(np.float64)
                    share = s.max(axis=1) / np.maximum(s.sum(axis=1), 1e-9)
                    best[lo + at : lo + end] = np.where(has, s.argmax(axis=1), len(m.languages))
                    score[lo + at : lo + end] = np.where(has, np.clip(share, 0, 1), 0)
                    at = end
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], names=["lang_pred", "score"])

    return F.arrow_udf(run, "lang_pred string, score double", ArrowUDFType.SCALAR_ITER).asNondeterministic()(text.cast("string"))


def identify_languages(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, one row for each row of ``docs``.

    The model learns from text and language of rows that aren't held out (crc32 of the id as text, modulo 4, is 2) and
    predicts from text alone. Null, empty and letterless texts are ``und`` with score 0, and so is every text if
    nothing can be learned. Rows with a null id are never held out. Other columns are ignored, whatever their names.
    """
    model = train(docs, id_col, text_col, lang_col, **options)
    out = docs.select(F.col(id_col).alias("doc_id"), predicted(spark, F.col(text_col), model).alias("of"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "of.lang_pred", "of.score")


#: How far above an even share of the scores the best language has to be.
MIN_LEAD = 1.1


def with_known_language(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_lead: float = MIN_LEAD) -> DataFrame:
    """``docs`` without the rows rejected: no letter, or of several languages none that stands out by ``min_lead``.

    Null, empty and letterless texts go; so does every row if nothing can be learned. Rows with a null id or language
    are judged as others are. Repeated rows stay or go together.
    """
    model = train(docs, id_col, text_col, lang_col)
    even = 1 / len(model.languages) if model else 1.0
    judged = docs.select(F.struct("*").alias("_doc"), predicted(spark, F.col(text_col), model).alias("_of"))
    return judged.where((F.col("_of.lang_pred") != UNDETERMINED) & (F.col("_of.score") >= min(min_lead * even, 0.99))).select("_doc.*")
