"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 52-bit hash of its id. A source that gives ``m`` whole passes and a part of another takes each
document ``m`` times, and once more where its hash lies below the source's threshold, so thresholds of larger budgets
hold all that smaller ones take. A threshold is found by histograms: sizes are summed by source and hash bucket, the
bucket that the budget ends in is found, and only that bucket is split again, until one hash value is left. Documents
are then filtered by comparing hashes; nothing is sorted, and the same rows give the same mix on any cluster.

The driver holds one row for each source (at most ``MAX_SOURCES``, else an error), never rows of documents. Tables with a
row a source are broadcast up to ``BROADCAST_SOURCES``, so that a large source is not gathered by its key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, temporary

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_PASSES = 2
#: Hex digits of the hash used, and bits resolved by each histogram.
HASH_DIGITS, LEVEL_BITS = 13, (13, 13, 13, 13)
MAX_SOURCES, BROADCAST_SOURCES = 1_000_000, 100_000


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> list[float]:
    """Target of each source, in the given order: shares by weight, stopped at ``most`` times its size, excess reshared."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    left, open_weight = share * sum(sizes), sum(weight)
    todo = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weight[i], i))
    for at, i in enumerate(todo):
        if not open_weight or left / open_weight <= most * sizes[i] / weight[i]:
            for j in todo[at:]:
                out[j] = left / open_weight * weight[j]
            break
        out[i] = float(most * sizes[i])
        left -= most * sizes[i]
        open_weight -= weight[i]
    return out


def _by_source(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_SOURCES else df


def plan_mix(spark: SparkSession, slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """``source, source_size, target, passes, threshold`` for the sources of ``slim`` (source, size, h).

    A document is taken ``passes`` times, and once more if ``h < threshold``.
    """
    found = slim.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["n"]) for r in found]
    goal = targets(sizes, weights, share, most)
    passes = [min(most, math.floor(t / n)) if n else 0 for t, n in zip(goal, sizes, strict=True)]
    budget = [t - p * n for t, p, n in zip(goal, passes, sizes, strict=True)]
    schema = "source string, source_size long, target double, passes int, threshold long"
    # A threshold that is still open: the hash prefix so far, and the sizes below it.
    prefix, below = [0] * len(found), [0] * len(found)
    live = {i for i in range(len(found)) if budget[i] > 0}
    top = sum(LEVEL_BITS)
    done = 0
    for bits in LEVEL_BITS:
        if not live:
            break
        marks = _by_source(spark, [(found[i]["source"], i, prefix[i], below[i], budget[i]) for i in sorted(live)], "_s string, i int, prefix long, below long, budget double")
        shift = top - done - bits
        inside = slim.join(marks, F.col("source").eqNullSafe(F.col("_s"))).where(F.shiftright("h", top - done) == F.col("prefix"))
        sums = inside.groupBy("i", "below", "budget", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"))
        upto = sums.withColumn("end", F.col("below") + F.sum("n").over(W.partitionBy("i").orderBy("b")))
        edge = upto.where("end > budget").groupBy("i").agg(F.min_by(F.struct("b", "end", "n"), "b").alias("e")).collect()
        hit = {r["i"]: r["e"] for r in edge}
        live &= set(hit)
        for i, e in hit.items():
            prefix[i], below[i] = int(e["b"]), int(e["end"] - e["n"])
        done += bits
        last = {i: int(e["n"]) for i, e in hit.items()}
    rows = []
    for i, r in enumerate(found):
        if budget[i] <= 0:
            threshold = 0
        elif i not in live:
            threshold = 1 << top
        else:  # the last hash value is taken if that comes nearer to the budget
            threshold = prefix[i] + (1 if 2 * below[i] + last[i] <= 2 * budget[i] else 0)
        rows.append((r["source"], sizes[i], float(goal[i]), passes[i], threshold))
    return _by_source(spark, rows, schema)


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("h"))


def _times(passes: str = "passes") -> Column:
    return F.col(passes) + (F.col("h") < F.col("threshold")).cast("int")


def mix_sources(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source``, one row for each row of ``docs``.

    Null and empty texts have size 0 and add nothing. Null sources form one source, the last. Rows that share an id
    are taken or left together. A source of size 0 has target 0; an empty table gives no rows. Other columns of
    ``docs`` are ignored, whatever their names.
    """
    slim = materialize(spark, _slim(docs, id_col, text_col, source_col), "sizes")
    plan = plan_mix(spark, slim, **options).withColumnRenamed("source", "_s")
    out = slim.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"), "source")


def mixed_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` as the mix takes them: left out, once, or repeated; texts move through no shuffle.

    Rows of a null id or source are mixed as others are, and so are null and empty texts, whose size is 0. Rows that
    share an id are taken or left together. An empty table stays empty.
    """
    with temporary(spark):
        plan = plan_mix(spark, materialize(spark, _slim(docs, id_col, text_col, source_col).select("source", "size", "h"), "sizes"), **options)
    plan = plan.select(F.col("source").alias("_mix_source"), "passes", "threshold")
    kept = docs.select(F.struct("*").alias("_doc"), F.col(source_col).cast("string").alias("_of"), id_hash(F.col(id_col)).alias("h"))
    kept = kept.join(plan, F.col("_of").eqNullSafe(F.col("_mix_source"))).withColumn("_times", _times()).where("_times > 0")
    return kept.select("_doc", F.explode(F.sequence(F.lit(1), "_times")).alias("_copy")).select("_doc.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS i FROM d GROUP BY source
), w AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s
), r AS (
  SELECT *, 2 * n / weight AS ratio,
    1.5::DOUBLE * (sum(n) OVER ()) - coalesce(sum(2 * n) OVER (ORDER BY 2 * n / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY 2 * n / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM w
), c AS (
  SELECT *, rest / open_weight <= ratio AS fits FROM r
), l AS (
  SELECT min_by(rest / open_weight, ratio * 1e6 + i) FILTER (WHERE fits) AS level, min(ratio) FILTER (WHERE fits) AS from_ratio FROM c
), t AS (
  SELECT source, n, CASE WHEN level IS NOT NULL AND ratio >= from_ratio THEN level * weight ELSE (2 * n)::DOUBLE END AS target FROM c, l
), p AS (
  SELECT *, CASE WHEN n > 0 THEN least(2, floor(target / n))::BIGINT ELSE 0 END AS passes FROM t
), u AS (
  SELECT source, h, sum(size) AS unit, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) - sum(size) AS below FROM d GROUP BY source, h
)
SELECT d.doc_id, d.size, p.n AS source_size, p.target,
       (d.size * (p.passes + CASE WHEN p.target - p.passes * p.n > 0 AND 2 * u.below + u.unit <= 2 * (p.target - p.passes * p.n) THEN 1 ELSE 0 END))::BIGINT AS taken,
       d.source
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.h = u.h
"""
