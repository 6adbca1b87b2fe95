"""I-Match fingerprints: hashes of a document's mid-frequency terms under several randomised lexicons.

Terms are runs of letters and digits, folded in A-Z. Their document frequencies are counted over all documents; the
lexicon holds those within a band of inverse document frequency. A term of the lexicon occurs in at least ``RARE`` of
all documents, so the lexicon has at most (mean distinct terms of a document) / ``RARE`` terms, whatever the corpus;
that bound is what lets it be broadcast. Terms above the band are within the same bound; they serve texts that the
band leaves with next to nothing. A fingerprint is the hash of all of a text's lexicon terms, sorted and
distinct, followed by hashes under ``SUBSETS`` random subsets of the lexicon. Subsets come in several densities, so
that texts of any length meet some of which they hold a few terms. Likeness is the share of equal hashes among the
subsets of which either text holds a term.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _MULT, BYTES_FOLDED, Powers, bounded_sample, ensure_importable, mix64, span_hashes, text_chunks

RARE, FREQUENT = 0.001, 0.1
SCARCE, FEW = 8, 16
#: One subset for each entry: it keeps one in so many terms of the lexicon.
SUBSETS = (4, 8, 16, 16, 32, 32, 64, 64, 64, 64, 128, 128, 128, 128, 256, 256, 256, 256, 256, 512, 512, 512, 512, 512)
#: Documents of a range of ids; the ranges that tables are cut into at most; ids drawn for each to find its bounds.
BUCKET_ROWS, MAX_BUCKETS, DRAWN = 2000, 32_768, 32
_FLUSH = 1 << 21

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_SALTS = mix64((np.arange(len(SUBSETS), dtype=np.uint64) + np.uint64(101)) * _MULT)


def terms(texts: pa.Array, powers: Powers) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, end row, and row and hash of every distinct term, sorted."""
    for lo, hi, data, offs in text_chunks(texts):
        inside = _TERM[data]
        edge = np.zeros(data.size + 1, bool)
        edge[offs] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        at, to = np.flatnonzero(first), np.flatnonzero(last) + 1
        row = np.searchsorted(offs, at, "right") - 1
        h = span_hashes(data, at, to, BYTES_FOLDED, powers) if at.size else np.zeros(0, np.uint64)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(h.size, bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield lo, hi, row[new], h[new]


def lexicon(docs: DataFrame, text_col: str = "text", rare: float = RARE, frequent: float = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the terms in at least ``rare`` of documents (at least two), how rare each is (0 the rarest), and
    whether its share lies in the band, that is, up to ``frequent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> pa.RecordBatch:
            h, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            uniq, back = np.unique(h, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(np.bincount(back, weights=n).astype(np.int64))], names=["h", "n"])

        for b in batches:
            for _, _, _, h in terms(b.column(0), powers):
                held.append(np.unique(h, return_counts=True))
                size += held[-1][0].size
                if size > _FLUSH:
                    yield merged()
                    held, size = [], 0
        if held:
            yield merged()

    total = docs.count()
    low = max(2, math.ceil(rare * total))
    high = max(low, math.floor(frequent * total))
    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    got = counted.where(F.col("n") >= low).select("h", "n").toPandas()
    h, n = got["h"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(h)
    h, n = h[order], n[order]
    place = np.empty(h.size, np.int64)
    place[np.lexsort((h, n))] = np.arange(h.size)
    return h, place, n <= high


class Fingerprints:
    """Fingerprints of texts under one lexicon; ``marks`` has a row of subset hashes for each text, 0 where it is empty.

    A text of which less than one in ``SCARCE`` known terms lies in the band, such as a copy from a group of over
    ``FREQUENT`` of all rows, is taken by the rarer half of its known terms (all of them up to ``FEW``).
    """

    BITS = 1 << 22

    def __init__(self, words: np.ndarray, place: np.ndarray | None = None, band: np.ndarray | None = None) -> None:
        self.words = words
        self.place = np.arange(words.size) if place is None else place
        self.band = np.ones(words.size, bool) if band is None else band
        self.maybe = np.zeros(self.BITS, bool)
        self.maybe[(words & np.uint64(self.BITS - 1)).astype(np.int64)] = True
        self.powers = Powers()

    def _kept(self, row: np.ndarray, spot: np.ndarray, rows: int) -> np.ndarray:
        """Which known terms, sorted by row, a text is taken by."""
        keep = self.band[spot]
        known, within = np.bincount(row, minlength=rows), np.bincount(row[keep], minlength=rows)
        scarce = SCARCE * within < known
        at = np.flatnonzero(scarce[row])
        if at.size:
            at = at[np.lexsort((self.place[spot[at]], row[at]))]
            own = row[at]
            turn = np.arange(at.size) - np.searchsorted(own, own)
            keep[at] = turn < np.maximum((known + 1) // 2, np.minimum(known, FEW))[own]
        return keep

    def of(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names: list[str] = []
        marks = np.zeros((len(texts), len(SUBSETS)), np.uint64)
        for lo, hi, row, h in terms(texts, self.powers):
            near = self.maybe[(h & np.uint64(self.BITS - 1)).astype(np.int64)]
            row, h = row[near], h[near]
            if self.words.size:
                spot = np.minimum(np.searchsorted(self.words, h), self.words.size - 1)
                known = self.words[spot] == h
                row, h, spot = row[known], h[known], spot[known]
                keep = self._kept(row, spot, hi - lo)
                row, h = row[keep], h[keep]
            else:
                row, h = row[:0], h[:0]
            cut = np.searchsorted(row, np.arange(hi - lo + 1))

            def summed(x: np.ndarray, cut: np.ndarray = cut) -> np.ndarray:
                run = np.zeros(x.size + 1, np.uint64)
                np.cumsum(x, out=run[1:])
                return run[cut[1:]] - run[cut[:-1]]

            whole = mix64(summed(mix64(h ^ _MULT)))
            for s, keep in enumerate(SUBSETS):
                m = mix64(h ^ _SALTS[s])
                member = (m >> np.uint64(40)) % np.uint64(keep) == 0
                total = summed(np.where(member, m | np.uint64(1), np.uint64(0)))
                some = summed(member.astype(np.uint64)) > 0
                marks[lo:hi, s] = np.where(some, (mix64(total) & np.uint64(0xFFFFFFFF)) | np.uint64(1), 0)
            for i in range(lo, hi):
                if cut[i - lo] == cut[i - lo + 1]:  # no lexicon term: the text itself
                    names.append("t" + hashlib.sha256((texts[i].as_py() or "").encode()).hexdigest()[:16])
                else:
                    names.append(f"{int(whole[i - lo]):016x}-" + "-".join(f"{int(x):08x}" for x in marks[i]))
        return names, marks


def likeness(a: str, am: np.ndarray, b: str, bm: np.ndarray) -> float:
    if a == b:
        return 1.0
    either = (am != 0) | (bm != 0)
    return float((am == bm)[either].mean()) if either.any() else 0.0


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the key, by two short scans of constant arrays."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>")
    fine = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    at = F.size(F.filter(coarse, lambda x: x <= key))
    inner = F.when(at > 0, F.size(F.filter(F.get(fine, at - 1), lambda x: x <= key))).otherwise(0)
    return F.when(at > 0, (at - 1) * step + inner).otherwise(0).cast("int")


def fingerprint_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: float = RARE, frequent: float = FREQUENT) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, a row for each row.

    The edited text has its last ``n_chars // 2`` code points replaced by as many first ones (or all) of the next
    document in ascending id; after the last comes the first. Null and empty texts are empty, rows with a null id come
    first, and rows that share an id follow each other by text. A single row is its own next. A text without known
    terms has the hash of itself as fingerprint. Other columns are ignored, whatever their names.

    Documents reach their neighbour by one exchange: ids are cut into ranges of about ``BUCKET_ROWS`` at quantiles of a
    sample (``MAX_BUCKETS`` ranges at most; they grow beyond), every range is sorted, which may spill, and the first
    document of each range is also sent to the range before it. Rows of one id stay in one range.
    """
    ensure_importable(spark)
    low = -(1 << 63)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(low)))
    shared = spark.sparkContext.broadcast(lexicon(docs, text_col, rare, frequent))
    total = docs.count()
    buckets = max(1, min(MAX_BUCKETS, total // BUCKET_ROWS))
    bounds: list[int] = []
    if buckets > 1:
        ids = sorted(r["key"] for r in bounded_sample(base.select("key"), "key", DRAWN * buckets).collect())
        bounds = sorted({ids[len(ids) * i // buckets] for i in range(1, buckets)})
    placed = base.withColumn("bucket", _bucket(F.col("key"), bounds))
    firsts = sorted(tuple(r) for r in placed.groupBy("bucket").agg(F.min("key")).collect())
    links = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]  # the first of all follows the last
    ends = spark.createDataFrame(links, "_first long, _to int") if links else spark.createDataFrame([], "_first long, _to int")
    closing = placed.join(F.broadcast(ends), F.col("key") == F.col("_first")).select("doc_id", "text", "key", F.col("_to").alias("bucket"), F.lit(1).alias("closing"))
    both = placed.select("doc_id", "text", "key", "bucket", F.lit(0).alias("closing")).unionByName(closing)
    sorted_rows = both.repartition(max(1, len(bounds) + 1), "bucket").sortWithinPartitions("bucket", "closing", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(*shared.value)
        kept: tuple | None = None  # the last row, which waits for its next: id, text, bucket, fingerprint, marks
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                ids, texts, bucket, closing = (b.column(i).to_pylist() for i in range(4))
                names, marks = prints.of(b.column(1))
                mine, theirs = [], []
                if kept is not None and kept[2] == bucket[0]:
                    mine.append(kept)
                    theirs.append(0)
                for i in range(len(ids) - 1):
                    if not closing[i] and bucket[i] == bucket[i + 1]:
                        mine.append((ids[i], texts[i], bucket[i], names[i], marks[i]))
                        theirs.append(i + 1)
                kept = None if closing[-1] else (ids[-1], texts[-1], bucket[-1], names[-1], marks[-1])
                edited = []
                for m, j in zip(mine, theirs):
                    k = len(m[1]) // 2
                    edited.append(m[1][: len(m[1]) - k] + texts[j][:k])
                enames, emarks = prints.of(pa.array(edited, pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([m[0] for m in mine], pa.int64()),
                        pa.array([len(m[1]) for m in mine], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                        pa.array([m[3] for m in mine], pa.string()),
                        pa.array(enames, pa.string()),
                        pa.array([likeness(m[3], m[4], e, em) for m, e, em in zip(mine, enames, emarks)], pa.float64()),
                        pa.array([likeness(m[3], m[4], names[j], marks[j]) for m, j in zip(mine, theirs)], pa.float64()),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return sorted_rows.select("doc_id", "text", "bucket", "closing").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
