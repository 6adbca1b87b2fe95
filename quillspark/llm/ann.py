"""Approximate nearest neighbours with an inverted multi-index.

Vectors are scaled to length 1 and cut into two halves. Each half is quantised on its own by k-means, trained on at most
``SAMPLE`` vectors (those with the smallest hashes of their ids); the number of centroids grows with the root of the
table, between ``CENTROIDS_LEAST`` and ``CENTROIDS_MOST``. A pair of centroids is a cell; every vector is listed in one.
A query visits cells in the order of summed distance to their two centroids, drawn from a heap over the two sorted
distance lists, until the cells hold the visit share of all vectors, and reranks their entries by exact cosine on the
original vectors in double precision.

The visit share is measured, not fixed: among the sample, ``TRIAL`` vectors ask for their exact neighbours, and the share
is what ``RECALL`` of these need. In a larger table the neighbours are nearer and the share falls; it is carried on from
a quarter of the sample and the whole of it, with half of the power seen. So clustered vectors take a small share, and
vectors without structure the large one that they need.

The driver holds the codebooks and the count of each cell, both bounded by ``CENTROIDS_MOST``. Cells are dealt into
blocks of a bounded number of vectors; a cell larger than that is split by a salt over several blocks, so a vector that
many rows share makes no large group. Each vector is sent to its block once; each query to the blocks of the cells it
visits. A task holds one block, past which its queries stream.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_sample, ensure_importable, materialize

CENTROIDS_LEAST, CENTROIDS_MOST = 16, 512
SAMPLE, ROUNDS = 20_000, 15
RECALL, TRIAL = 0.95, 200
#: Vectors of a block, by the size of the table: a 256th of it, within these bounds.
BLOCK_LEAST, BLOCK_MOST = 4096, 65_536
NEAREST, QUERY_EVERY = 5, 50


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: vectors that are neither null nor zero and hold only finite numbers, of the commonest length."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    ok = v.where("vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    commonest = ok.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return ok.where(F.size("v") == (commonest[0]["d"] if commonest else 0))


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    pick = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[pick.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = nearest_centre(x, centres)
        for c in range(len(centres)):
            own = x[near == c]
            if len(own):
                centres[c] = own.mean(axis=0)
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def visited_cells(one: np.ndarray, two: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells by summed distance until they hold ``enough`` rows: a heap over pairs of places in the two sorted lists."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    heap, seen, out, got = [(one[a[0]] + two[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(two) + int(b[j])
        if counts[cell]:
            out.append(cell)
            got += int(counts[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (one[a[x]] + two[b[y]], x, y))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither vanish nor overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def centroids_for(total: int) -> int:
    return min(CENTROIDS_MOST, max(CENTROIDS_LEAST, round(math.sqrt(total) / 4)))


def share_needed(units: np.ndarray, books: list[np.ndarray], nearest: int = NEAREST, recall: float = RECALL, trial: int = TRIAL) -> float:
    """The share of all vectors that the first cells have to hold for queries among them to find ``recall`` of their
    exact neighbours; 1 if there are none."""
    half = len(books[0][0])
    k2 = len(books[1])
    cell = nearest_centre(units[:, :half], books[0]) * k2 + nearest_centre(units[:, half:], books[1])
    counts = np.bincount(cell, minlength=len(books[0]) * k2)
    needs: list[np.ndarray] = []
    for q in range(min(trial, len(units))):
        score = units @ units[q]
        score[q] = -2.0
        best = np.argsort(-score, kind="stable")[: min(nearest, len(units) - 1)]
        apart = ((units[q, :half] - books[0]) ** 2).sum(axis=1)[:, None] + ((units[q, half:] - books[1]) ** 2).sum(axis=1)[None, :]
        order = np.argsort(apart, axis=None, kind="stable")
        upto = np.empty(order.size)
        upto[order] = np.cumsum(counts[order])
        needs.append(upto[cell[best]] / len(units))
    found = np.concatenate(needs) if needs else np.zeros(0)
    return float(np.quantile(found, recall)) if found.size else 1.0


def visit_share(units: np.ndarray, books: list[np.ndarray], total: int, nearest: int = NEAREST) -> float:
    """``share_needed`` of the sample, carried on to ``total`` vectors with half of the power that it falls by."""
    share = share_needed(units, books, nearest)
    if total <= len(units):
        return share
    part = share_needed(units[: max(2, len(units) // 4)], books, nearest)
    power = max(0.0, math.log(part / share) / math.log(4)) if share else 0.0
    return share * (len(units) / total) ** (power / 2)


def search(
    spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = QUERY_EVERY, nearest: int = NEAREST, centroids: int | None = None, sample: int = SAMPLE, visit: float | None = None, visit_least: int = 0, each_row: bool = False
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for queries, the rows whose id is divisible by ``every``, against all rows.

    Nearest first by cosine, ties to the smaller id. Vectors that are null, zero, hold null or non-finite components,
    have a null id, or aren't of the commonest length take no part. Rows that repeat an id count once, by their best
    score, and a query never finds its own id; with ``each_row`` they are candidates, and queries, of their own, and a
    query leaves out its own row only. Fewer candidates than ``nearest`` are all returned; an empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    ensure_importable(spark)
    result = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vector_col)
    total = rows.count()
    drawn = bounded_sample(rows, "vec_id", sample).select("v").toArrow()
    if not drawn.num_rows:
        return spark.createDataFrame([], result)
    units = _unit(_matrix(drawn.column("v").combine_chunks()))
    half = units.shape[1] // 2
    k = centroids or centroids_for(total)
    books = [kmeans(units[:, :half], k) if half else np.zeros((1, 0)), kmeans(units[:, half:], k)]
    k2 = len(books[1])
    enough = max(1, visit_least, math.ceil((visit_share(units, books, total, nearest) if visit is None else visit) * total))
    shared = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        for b in batches:
            if b.num_rows:
                u = _unit(_matrix(b.column(1)))
                cell = nearest_centre(u[:, :half], one) * k2 + nearest_centre(u[:, half:], two)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32))], names=["vec_id", "v", "cell"])

    # Rows are numbered as they are written, so a number stays with its row.
    index = materialize(spark, rows.mapInArrow(assign, "vec_id long, v array<double>, cell int").withColumn("row", F.monotonically_increasing_id()), "cells")
    counts = np.zeros(len(books[0]) * k2, np.int64)
    for r in index.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]

    # Blocks: cells in order, closed when full; a large cell has blocks of its own, told apart by a salt.
    size = min(BLOCK_MOST, max(BLOCK_LEAST, total // 256))
    parts = np.maximum(1, -(-counts // size))
    first, at, room = np.zeros(counts.size, np.int64), -1, 0
    for c in np.flatnonzero(counts).tolist():
        if parts[c] > 1:
            first[c], at, room = at + 1, at + int(parts[c]), 0
        else:
            if at < 0 or counts[c] > room:
                at, room = at + 1, size
            first[c] = at
            room -= int(counts[c])
    layout = spark.sparkContext.broadcast((counts, first, parts))
    cells = spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in np.flatnonzero(counts).tolist()], "_c int, _first long, _parts long")
    block = F.col("_first") + F.pmod(F.xxhash64("row"), F.col("_parts"))
    none = F.array().cast("array<int>")
    placed = index.join(F.broadcast(cells), F.col("cell") == F.col("_c")).select(block.alias("block"), F.lit(0).alias("kind"), "vec_id", "row", "v", "cell", none.alias("cells"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        counts, first, parts = layout.value
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit(_matrix(b.column(1)))
            src, blocks, lists = [], [], []
            for i in range(len(u)):
                d1 = ((u[i, :half] - one) ** 2).sum(axis=1)
                d2 = ((u[i, half:] - two) ** 2).sum(axis=1)
                to: dict[int, list[int]] = {}
                for c in visited_cells(d1, d2, counts, enough):
                    for s in range(int(parts[c])):
                        to.setdefault(int(first[c]) + s, []).append(c)
                src += [i] * len(to)
                blocks += list(to)
                lists += list(to.values())
            t = pa.array(src, pa.int64())
            n = len(src)
            columns = [pa.array(blocks, pa.int64()), pa.array(np.ones(n, np.int32)), b.column(0).take(t), b.column(2).take(t), b.column(1).take(t), pa.array(np.zeros(n, np.int32)), pa.array(lists, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "kind", "vec_id", "row", "v", "cell", "cells"])

    schema = "block long, kind int, vec_id long, row long, v array<double>, cell int, cells array<int>"
    sent = index.where(F.col("vec_id") % every == 0).select("vec_id", "v", "row").mapInArrow(route, schema)

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        ids = own = v = np.zeros(0)
        by_cell: dict[int, np.ndarray] = {}
        for b in batches:
            blocks, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            found: list[tuple[int, int, int, float]] = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if now != blocks[lo]:
                    now, held, by_cell = blocks[lo], [], {}
                if kinds[lo] == 0:
                    held.append((part.column(2).to_numpy(), part.column(3).to_numpy(), _unit(_matrix(part.column(4))), part.column(5).to_numpy()))
                    continue
                if held:  # the block's vectors are all there: those of a cell side by side, in the order of their ids
                    ids, own, v, cell = (np.concatenate(x) for x in zip(*held))
                    held = []
                    order = np.lexsort((own, ids, cell))
                    ids, own, v, cell = ids[order], own[order], v[order], cell[order]
                    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                    by_cell = {int(cell[a]): np.arange(a, z) for a, z in zip(starts, np.r_[starts[1:], cell.size])}
                q = _unit(_matrix(part.column(4)))
                for i, (query, row, wanted) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(6).to_pylist())):
                    near = [by_cell[c] for c in wanted if c in by_cell]
                    if not near:
                        continue
                    at = np.concatenate(near)
                    at = at[own[at] != row] if each_row else at[ids[at] != query]
                    score = np.einsum("ij,j->i", v[at], q[i])  # row by row, so equal vectors score alike
                    best = np.lexsort((ids[at], -score))
                    if not each_row:
                        _, lead = np.unique(ids[at][best], return_index=True)  # where each id comes first, by its best score
                        best = best[np.sort(lead)]
                    found += [(row, query, int(ids[at[j]]), float(score[j])) for j in best[:nearest]]
            columns = list(zip(*found)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["row", "query_id", "vec_id", "score"])

    dealt = placed.unionByName(sent).repartition("block").sortWithinPartitions("block", "kind")
    met = dealt.mapInArrow(rerank, "row long, query_id long, vec_id long, score double")
    asker = "row" if each_row else "query_id"
    if not each_row:
        met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy(asker).orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
