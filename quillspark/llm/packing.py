"""Packing documents into fixed windows: non-negative least squares over length combinations.

Each document is its token ids and one end id. Windows that a document fills alone are cut off its front; what remains,
its tail, is shorter than a window. The histogram of tail lengths has at most ``window`` bins, whatever the corpus, and
all planning is done on it:

1. combinations of two or three lengths that fill a window exactly are enumerated;
2. non-negative least squares finds how often each should be used to use up the histogram;
3. the counts are rounded, to no more than is there; then combinations are taken greedily, those of the largest
   solutions first, as long as all their lengths are left;
4. the residual tails, which fill no window together by twos or threes, are packed greedily too: each goes on where the
   last one ended and is cut at the window's border, the last window into powers of two, so nothing is padded.

A tail's place follows from its length and its rank among tails of that length by arithmetic on the plan, so placing
them needs no sort and no group in one task: ranks come from counts by length and salt. The driver holds the histogram
and the plan, both bounded by the window.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ensure_importable, materialize

WINDOW = 1024
END_ID = 0
#: Groups that the tails of one length are ranked in, so that a common length makes no large group.
SALTS = 1024
#: Windows that a document fills alone are numbered from here, by document and place.
ALONE_FROM = 1 << 40
PER_DOCUMENT = 1 << 22


# --- token ids ----------------------------------------------------------------------------------

# Fixed value: how a byte-level tokenizer of this form splits a text before it merges bytes.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if printable, else the next from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranked(file: dict):
    """A merger by rank that gives the ids of a ``tokenizers`` file; None unless the file is of the form it needs.

    It is needed that the text is taken as it is, split in the byte-level way, and that the ids of merged pieces rise
    in the order of their merges, each piece having one.
    """
    model, split = file["model"], file.get("pre_tokenizer") or {}
    plain = not file.get("normalizer") and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    byte, special = _byte_of(), {t["content"] for t in file.get("added_tokens", [])}
    vocabulary = {x: i for x, i in model["vocab"].items() if x not in special}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocabulary.get(a + b, -1) for a, b in merges]
    if any(c not in byte for x in vocabulary for c in x) or len(vocabulary) != 256 + len(made) or min(made, default=0) < 0 or any(a >= b for a, b in zip(made, made[1:])):
        return None
    import tiktoken

    return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks={bytes(byte[c] for c in x): i for x, i in vocabulary.items()}, special_tokens={})


class Tokens:
    """Ids of texts by the ``tokenizers`` file at ``path``.

    Texts go to a merger by rank, several times as fast, if the file is of the form that makes the ids equal; texts that
    hold one of the file's added tokens, and all texts of other files, go to ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.path = path
        self.added = [t["content"] for t in file.get("added_tokens", [])]
        self.ranked = _ranked(file)

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            if self.ranked is None or any(s in t for s in self.added):
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32))
            else:
                out.append(np.array(self.ranked.encode_ordinary(t), np.uint32))
        return out


@functools.lru_cache(maxsize=2)
def _tokens(path: str) -> Tokens:
    """One for each path and Python worker; it holds the vocabulary only, nothing of the texts."""
    return Tokens(path)


# --- the plan -----------------------------------------------------------------------------------


@dataclass
class Plan:
    """Where tails go. Rows of ``start, stop, sequence, offset`` hold, by length and rank, uses of combinations.

    ``from_rank`` and ``base``, by length: the first rank that is laid end to end, and where that length begins there.
    Laid end to end, position p is in window ``laid_from + p // window``, but for the last window's powers of two,
    which ``borders`` gives.
    """

    window: int
    key: np.ndarray
    stop: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    from_rank: np.ndarray
    base: np.ndarray
    laid_from: int
    laid: int
    borders: np.ndarray
    ordinal: np.ndarray


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths that sum to ``window``, the last 0 in pairs: all of the lengths that occur, at most
    ``window ** 2 / 12`` or so."""
    there = np.flatnonzero(histogram)
    there = there[there > 0]
    has = np.zeros(window + 1, bool)
    has[there] = True
    found = [np.array([(a, window - a, 0) for a in there.tolist() if a <= window - a and has[window - a]], np.int64).reshape(-1, 3)]
    for a in there[there <= window // 3].tolist():
        b = there[(there >= a) & (there <= (window - a) // 2)]
        b = b[has[window - a - b]]
        found.append(np.stack([np.full(b.size, a), b, window - a - b], axis=1))
    return np.concatenate(found)


def repeat_counts(histogram: np.ndarray, combos: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares: uses x >= 0 that bring the used lengths nearest to the histogram (accelerated
    projected gradient; the matrix is kept as the combinations' lengths)."""
    if not len(combos):
        return np.zeros(0)
    h = histogram.astype(float).copy()
    h[0] = 0
    part = combos > 0

    def used(x: np.ndarray) -> np.ndarray:
        out = np.zeros(h.size)
        for k in range(3):
            out += np.bincount(combos[:, k], weights=x * part[:, k], minlength=h.size)
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return (r[combos] * part).sum(axis=1)

    v = np.ones(len(combos))
    for _ in range(30):
        v = back(used(v))
        v /= max(np.linalg.norm(v), 1e-300)
    step = 1 / max(1.05 * np.linalg.norm(back(used(v))), 1e-9)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        z = np.maximum(y - step * back(used(y) - h), 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = z + (t - 1) / s * (z - x)
        x, t = z, s
    return x


def make_plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """``histogram``: number of tails by length, 0 to ``window - 1``."""
    h = np.asarray(histogram, np.int64)
    combos = combinations(h, window)
    x = repeat_counts(h, combos)
    left, start = h.tolist(), [0] * window
    rows: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def use(parts: list[int], n: int) -> None:
        nonlocal sequence
        offset = 0
        for length in parts:
            rows.append((length, start[length], start[length] + n, sequence, offset))
            start[length] += n
            left[length] -= n
            offset += length
        sequence += n

    order = np.lexsort((np.arange(len(combos)), -x))
    listed = [[z for z in c if z] for c in combos[order].tolist()]
    wanted = np.rint(x[order]).astype(np.int64).tolist()
    for rounded in (True, False):  # as often as the rounded count says; then, greedily, as often as lengths are left
        for parts, n in zip(listed, wanted):
            if (n or not rounded) and all(left[z] for z in parts):
                n = min([left[z] // parts.count(z) for z in parts] + [n] * rounded)
                if n:
                    use(parts, n)
    left, start = np.array(left, np.int64), np.array(start, np.int64)
    lengths = np.arange(window)
    base = np.r_[0, np.cumsum(left * lengths)][:-1]
    laid = int((left * lengths).sum())
    borders, at = [], laid - laid % window
    for bit in reversed(range(window.bit_length())):
        if (laid % window) >> bit & 1:
            borders.append(at)
            at += 1 << bit
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(window, (table[:, 0] << 44) + table[:, 1], (table[:, 0] << 44) + table[:, 2], table[:, 3], table[:, 4], start, base, sequence, laid, np.array([*borders, laid], np.int64), np.r_[0, np.cumsum(h)][:-1])


def _laid_parts(plan: Plan, p: int, length: int) -> list[tuple[int, int, int]]:
    """Sequence, offset there and length of the parts of ``length`` ids laid from position ``p``."""
    out = []
    whole = plan.laid - plan.laid % plan.window
    while length:
        if p < whole:
            sequence, offset = plan.laid_from + p // plan.window, p % plan.window
            room = plan.window - offset
        else:
            k = int(np.searchsorted(plan.borders, p, "right")) - 1
            sequence, offset = plan.laid_from + whole // plan.window + k, p - int(plan.borders[k])
            room = int(plan.borders[k + 1]) - p
        n = min(room, length)
        out.append((sequence, offset, n))
        p, length = p + n, length - n
    return out


# --- the operator -------------------------------------------------------------------------------


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenized(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, path: str, window: int, end_id: int) -> DataFrame:
    """``doc_id, doc_tokens, crcs`` (of windows that the document fills alone), ``tail`` (its other ids), ``salt``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, turn = _tokens(path), 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                n, crcs, tails, salts = [], [], [], []
                for ids in tokens.ids([t or "" for t in part.column(1).to_pylist()]):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    full = ids.size // window
                    n.append(ids.size)
                    crcs.append([zlib.crc32(ids[i * window : (i + 1) * window]) for i in range(full)])
                    tails.append(ids[full * window :].astype("<u4").tobytes())
                    salts.append((zlib.crc32(tails[-1]) + turn) % SALTS)  # equal rows take turns
                    turn += 1
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.array(salts, pa.int32())], names=["doc_id", "doc_tokens", "crcs", "tail", "salt"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>, tail binary, salt int")


def pack_sequences(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, one row for each piece.

    Every row of ``docs`` is a document of its own, repeated rows and null ids too; a null or empty text is its end id
    alone. Each id lies in one piece. Sequences hold ``window`` ids, but for the last few, whose sizes are powers of
    two, so none is padded. An empty table gives no pieces. Other columns are ignored, whatever their names.
    """
    ensure_importable(spark)
    rows = materialize(spark, tokenized(spark, docs, id_col, text_col, tokenizer or tokenizer_path(), window, end_id), "tokens")
    rows = rows.withColumn("size", (F.col("doc_tokens") % window).cast("int"))
    counts = rows.groupBy("size", "salt").agg(F.count("*").alias("n"))
    by_size = counts.groupBy("size").agg(F.sum("n").alias("n")).collect()
    histogram = np.zeros(window, np.int64)
    for r in by_size:
        histogram[r["size"]] = r["n"]
    plan = spark.sparkContext.broadcast(make_plan(histogram, window))

    before = counts.select(F.col("size").alias("_z"), F.col("salt").alias("_s"), (F.sum("n").over(W.partitionBy("size").orderBy("salt")) - F.col("n")).alias("before"))
    within = rows.withColumn("place", F.row_number().over(W.partitionBy("size", "salt").orderBy("doc_id", "doc_tokens", "tail", "crcs")) - 1)
    ranked = within.join(before, (F.col("size") == F.col("_z")) & (F.col("salt") == F.col("_s"))).select("doc_id", "doc_tokens", "crcs", "tail", "size", (F.col("before") + F.col("place")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for b in batches:
            size, rank = b.column(4).to_numpy().astype(np.int64), b.column(5).to_numpy()
            key = (size << 44) + rank
            hit = np.searchsorted(p.key, key, "right") - 1
            fits = (hit >= 0) & (size > 0)
            if p.key.size:
                fits &= key < p.stop[hit]
                sequence, offset = p.sequence[hit] + key - p.key[hit], p.offset[hit]
            ordinal = p.ordinal[size] + rank
            laid = p.base[size] + (rank - p.from_rank[size]) * size
            out: list[tuple] = []
            for i, (doc_id, tokens, crcs, tail) in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)))):
                alone = ALONE_FROM + int(ordinal[i]) * PER_DOCUMENT
                out += [(doc_id, k * p.window, p.window, c, tokens, alone + k, 0) for k, c in enumerate(crcs)]
                at = len(crcs) * p.window
                if fits[i]:
                    out.append((doc_id, at, int(size[i]), zlib.crc32(tail), tokens, int(sequence[i]), int(offset[i])))
                elif size[i]:
                    done = 0
                    for s, o, n in _laid_parts(p, int(laid[i]), int(size[i])):
                        out.append((doc_id, at + done, n, zlib.crc32(tail[4 * done : 4 * (done + n)]), tokens, s, o))
                        done += n
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
