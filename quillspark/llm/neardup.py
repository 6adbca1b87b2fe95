"""MinHash near-duplicate groups by bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its distinct word shingles. Its sketch is the ``k`` smallest of them. The
steps, all over every document:

1. Equal sets form one class, whatever the number of copies; from here on a class is one node.
2. Inverted lists: every value that two or more sketches retain lists its nodes. A pair that links shares most of its
   sketch, so each node is listed only under its rarest retained values, just as many as such a pair cannot avoid
   (prefix filtering). Passages and lines that many documents share thereby make no long lists, and nothing is capped.
3. Each list proposes its best connected node, its head, against the others (a star, linear in the list). The union
   sketch estimates each overlap and drops the clearly unlike; exact Jaccard on full sets confirms the rest.
4. Components of the confirmed links. Lists that then still hold nodes of different components are open. Their nodes
   are listed anew, by what tells them from their list's head (below), and these lists, which are short, propose first
   stars, then all pairs that are still across components. Exact Jaccard confirms, so no link between components is
   lost, and a group of many copies edited too much to link proposes next to nothing.

**Lists of differences.** Let D(x) be the symmetric difference of x and the head h, d its size, c = (1 - t) / (1 + t) for
the threshold t, and s(x) = d(x) - c n(x). As x and y differ by d(x) + d(y) - 2 |D(x) and D(y)| shingles, they link just
if 2 |D(x) and D(y)| >= s(x) + s(y). A node that isn't linked to h has s > c n(h), h itself has -c n(h) and no node has
less; so of a pair across components one at least is outside the head's, the sum is above 0, and D(x) and D(y) share as
many elements as that says. Elements are ordered by how many nodes of the head's lists hold them; a pair shares one
among the first d - o + 1 of either if it shares o. Copies with edits of their own share next to no elements early on.

The estimate keeps a pair down to ``slack`` below the threshold (over five standard deviations at the default ``k``);
sets no larger than the sketch are compared exactly at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _MULT, Powers, components, ensure_importable, materialize_numbers, mix64, shingle_sets, temporary, written_by_workers

WIDTH = 5
NUMERATOR, DENOMINATOR = 85, 100
SKETCH = 48
SLACK = 0.28
#: Bits of the filter that spares reading texts of nodes without candidates; fixed, so its size never grows.
FILTER_BITS = 1 << 24
#: Tables of ids are broadcast up to so many rows (8 bytes each), by their count; larger ones are joined by exchange.
BROADCAST_IDS = 1 << 20


def _row_id(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def _with_ids(rows: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """``rows`` whose ``column`` is (left_semi) or isn't (left_anti) among ``ids``, a table of one column of that name."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, column, how)


def _digest(sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One 64-bit value for each set, from sums that don't depend on order; 0 for empty sets."""
    size = np.diff(offs)
    out = np.zeros(size.size, np.uint64)
    full = size > 0
    if full.any():
        h = sets.view(np.uint64)
        at = offs[:-1][full]
        one, two = np.add.reduceat(mix64(h ^ _MULT), at), np.add.reduceat(mix64(h + _MULT), at)
        out[full] = mix64(one + mix64(two + size[full].astype(np.uint64)))
    return out.view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = SKETCH) -> DataFrame:
    """``doc_id, rid, n_shingles, node, sketch`` for every row; rid tells texts of one id apart, node is the digest of
    the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            for lo, hi, offs, sets in shingle_sets(b.column(2), width, powers):
                size = np.diff(offs)
                keep = np.arange(sets.size) - np.repeat(offs[:-1], size) < k
                at = np.r_[0, np.cumsum(np.minimum(size, k))].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(_digest(sets, offs), pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(sets[keep], pa.int64()))],
                    names=["doc_id", "rid", "n_shingles", "node", "sketch"],
                )

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), _row_id(id_col, text_col).alias("rid"), F.col(text_col).cast("string").alias("text"))
    return ids.mapInArrow(run, "doc_id long, rid long, n_shingles long, node long, sketch array<long>")


def _least_overlap(size: Column, n: Column, k: int, num: int, den: int, slack: float) -> Column:
    """How many values of its sketch a node shares at least with any node it may link to.

    A whole set of n values shares ceil(n num / den) with a partner; a partner of up to n den / num values that exceed
    its sketch may drop as many of them as it has over k. A set of n and one of m share at least (n + m) num /
    (num + den) values, so the sketches share that less m - k; the largest m is the worst, as num < den. Below the
    estimate's bound nothing is gained.
    """
    exact = F.ceil(n * num / den)
    m = F.floor(n * den / num)
    dropped = F.ceil((n + m) * num / (num + den)) - (m - k)
    estimate = F.ceil(size * (num / den - slack))
    return F.when(m <= k, exact).when(n <= k, F.least(exact, F.greatest(dropped, F.lit(0)))).otherwise(estimate)


def _listed(classes: DataFrame, k: int, num: int, den: int, slack: float) -> DataFrame:
    """``value, node, n, weight``: each node under its rarest shared values; weight sums how often its values recur."""
    tokens = classes.select("node", "n", F.explode("sketch").alias("value"))
    common = tokens.groupBy("value").agg(F.count("*").alias("df")).where("df > 1").select(F.col("value").alias("_v"), "df")
    shared = tokens.join(common, tokens["value"] == common["_v"]).groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("rare"), F.sum("df").alias("weight"))
    size = F.least("n", F.lit(k))
    alone = size - F.size("rare")
    take = (size - _least_overlap(size, F.col("n"), k, num, den, slack) + 1 - alone).cast("int")
    return shared.withColumn("take", take).where("take > 0").select("node", "n", "weight", F.explode(F.expr("slice(rare, 1, take)")).alias("e")).select(F.col("e.value").alias("value"), "node", "n", "weight")


def _size_fits(a: str, b: str, num: int, den: int) -> Column:
    return (F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num)


def _estimated(pairs: DataFrame, classes: DataFrame, k: int, num: int, den: int, slack: float) -> DataFrame:
    """Pairs ``a, b`` whose union sketch allows a link; ``sure``: the sketches are the whole sets and say it is one."""
    own = _with_ids(classes.select("node", "n", "sketch"), pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi")
    left = own.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = own.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    met = pairs.join(left, "a").join(right, "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = F.array_intersect("sa", "sb")
    whole = (F.col("na") <= k) & (F.col("nb") <= k)
    met = met.withColumn("whole", whole).withColumn("hits", F.when(whole, F.size(both)).otherwise(F.size(F.array_intersect(union, both)))).withColumn("of", F.when(whole, F.size(F.array_union("sa", "sb"))).otherwise(F.size(union)))
    fits = F.when(F.col("whole"), F.col("hits") * den >= F.col("of") * num).otherwise(F.col("hits") >= F.ceil(F.col("of") * (num / den - slack)))
    return met.where(fits).select("a", "b", F.col("whole").alias("sure"))


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``node, full`` (sorted hashes) for the wanted nodes (``node, rid``), made again from their texts."""
    bits = F.pmod(F.xxhash64("rid"), F.lit(FILTER_BITS))
    cells = wanted.select(bits.alias("bit")).groupBy(F.expr("bit div 32").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("mask")).collect()
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    for c in cells:
        table[c["cell"]] = c["mask"]
    filled = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            at = b.column(1).to_numpy(zero_copy_only=False)
            maybe = (filled.value[at // 32] >> (at % 32).astype(np.uint32)) & 1 == 1
            b = b.filter(pa.array(maybe))
            for lo, hi, offs, sets in shingle_sets(b.column(2), width, powers):
                full = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(sets, pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(_digest(sets, offs), pa.int64()), full], names=["rid", "node", "full"])

    rows = docs.select(_row_id(id_col, text_col).alias("rid"), F.col(text_col).cast("string").alias("text")).select("rid", bits.cast("long").alias("bit"), "text")
    made = rows.mapInArrow(run, "rid long, node long, full array<long>")
    return made.join(wanted, ["rid", "node"]).groupBy("node").agg(F.first("full").alias("full"))


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` that link: exact Jaccard of the full sets against the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = np.zeros(b.num_rows, bool)
            fa, fb = b.column(2), b.column(3)
            va, vb = fa.values.to_numpy(), fb.values.to_numpy()
            oa, ob = fa.offsets.to_numpy(), fb.offsets.to_numpy()
            for i in range(b.num_rows):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                spot = np.minimum(np.searchsorted(y, x), y.size - 1)
                same = np.count_nonzero(y[spot] == x)
                linked[i] = same * den >= num * (x.size + y.size - same)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(linked))

    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("full").alias("fa")), "a").join(sets.select(F.col("node").alias("b"), F.col("full").alias("fb")), "b")
    return met.select("a", "b", "fa", "fb").mapInArrow(run, "a long, b long")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the ``label`` of their ``node``; a node without links is its own."""
    return rows.join(labels.select(F.col("node").alias("_n"), F.col("label").alias("_l")), F.col("node") == F.col("_n"), "left").withColumn("label", F.coalesce("_l", "node")).drop("_n", "_l")


def _mixed(rows: DataFrame, *key: str) -> DataFrame:
    """The rows of lists (by ``key``) that hold nodes of more than one label."""
    mixed = rows.groupBy(*key).agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo <> _hi").select(*[F.col(k).alias(f"_{k}") for k in key])
    same = [F.col(k) == F.col(f"_{k}") for k in key]
    return rows.join(mixed, same).drop(*[f"_{k}" for k in key])


def _able(open_lists: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of the open lists whose node shares enough of its set with other open nodes to link with any."""
    held = sets.select("node", F.explode("full").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node"))
    alone = held.where("c = 1").groupBy("node").agg(F.count("*").alias("u")).select(F.col("node").alias("_n"), "u")
    counted = open_lists.join(alone, F.col("node") == F.col("_n"), "left").drop("_n").withColumn("u", F.coalesce("u", F.lit(0)))
    return counted.where(F.col("u") * num <= (F.col("n") - F.col("u")) * (den - num)).drop("u")


def _differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``h, node`` with ``diff``, the symmetric difference of their sets, for each row of ``members``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                b = big.slice(lo, 256)
                diff = [np.setxor1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True) for x, y in zip(b.column(2), b.column(3))]
                offs = np.r_[0, np.cumsum([x.size for x in diff])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(diff), pa.int64()))], names=["h", "node", "diff"])

    met = members.join(sets.select(F.col("node").alias("h"), F.col("full").alias("fh")), "h").join(sets.select("node", F.col("full").alias("fn")), "node")
    return met.select("h", "node", "fh", "fn").mapInArrow(run, "h long, node long, diff array<long>")


def _difference_lists(spark: SparkSession, members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``h, e, node, n, p, d, s, wide, near``: nodes by the elements of their difference from their head.

    ``members``: node, n, h, hn, and inside: whether it is in the head's component. s is the module's s times num + den.
    p is the element's place among the node's, rarest first. An inside node meets outside ones only; an outside node
    meets inside nodes through all its rows, and other outside ones through those marked ``near``, its first.
    """
    c, both = den - num, 2 * (den + num)
    diffs = materialize_numbers(spark, _differences(members.select("h", "node"), sets), "differences")
    held = diffs.select("h", "node", F.explode("diff").alias("e"))
    shared = held.groupBy("h", "e").agg(F.count("*").alias("df")).where("df > 1").select(F.col("h").alias("_h"), F.col("e").alias("_e"), "df")
    rare = held.join(shared, (F.col("h") == F.col("_h")) & (F.col("e") == F.col("_e"))).groupBy("h", "node").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("rare"))
    met = members.join(rare, ["h", "node"]).join(diffs.select("h", "node", F.size("diff").alias("d")), ["h", "node"])
    met = met.withColumn("s", F.col("d") * (den + num) - F.col("n") * c)
    least = met.where("inside").groupBy("h").agg(F.min("s").alias("_low")).select(F.col("h").alias("_h"), "_low")
    met = met.join(least, F.col("h") == F.col("_h"), "left").drop("_h")
    past = F.floor((F.col("s") + F.col("hn") * c) / both) + 1  # shared with any outside node
    inner = F.when(F.col("_low").isNotNull(), F.greatest(F.lit(1), F.ceil((F.col("s") + F.col("_low")) / both)))  # with any inside one
    met = met.withColumn("first", F.col("d") - past + 1).withColumn("reach", F.when(F.col("inside"), F.col("first")).otherwise(F.greatest("first", F.coalesce(F.col("d") - inner + 1, "first"))))
    met = met.withColumn("alone", F.col("d") - F.size("rare"))
    listed = met.where("reach > alone").select("h", "node", "n", "inside", "d", "s", "first", "alone", F.posexplode(F.expr("slice(rare, 1, cast(reach - alone as int))")).alias("i", "x"))
    listed = listed.select("h", F.col("x.e").alias("e"), "node", "n", "inside", "d", "s", (F.col("alone") + F.col("i") + 1).alias("p"), "first")
    return materialize_numbers(spark, listed.withColumn("near", F.col("p") <= F.col("first")).drop("first"), "listed")


def _meets(rows: DataFrame, others: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b`` for rows of one difference list whose nodes have different labels and may share enough elements."""
    o = others.select(*[F.col(x).alias(f"o_{x}") for x in ("h", "e", "node", "n", "label", "d", "s", "p")])
    need = F.greatest(F.lit(1), F.ceil((F.col("s") + F.col("o_s")) / (2 * (den + num))))
    may = (F.col("p") <= F.col("d") - need + 1) & (F.col("o_p") <= F.col("o_d") - need + 1)
    met = rows.join(o, (F.col("h") == F.col("o_h")) & (F.col("e") == F.col("o_e")) & (F.col("label") != F.col("o_label")) & _size_fits("n", "o_n", num, den) & may)
    return met.select(F.greatest("node", "o_node").alias("a"), F.least("node", "o_node").alias("b")).distinct()


def _links_across(spark: SparkSession, led: DataFrame, labels: DataFrame, read_sets: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """``labels`` after the links that lists still open at them hold."""
    open_lists = materialize_numbers(spark, _mixed(_labelled(led, labels), "value"), "mixed")
    sets = materialize_numbers(spark, read_sets(open_lists.select("node")), "sets")
    able = _mixed(_able(open_lists, sets, num, den), "value")
    heads = open_lists.where("node = h").select(F.col("h").alias("_h"), F.col("label").alias("_of")).distinct()
    members = able.join(heads, F.col("h") == F.col("_h")).select("node", "n", "h", "hn", (F.col("label") == F.col("_of")).alias("inside")).distinct()
    lists = _difference_lists(spark, materialize_numbers(spark, members.where("node <> h"), "members"), sets, num, den)

    def first_pairs(rows: DataFrame) -> DataFrame:
        """Each list's largest node against the others: linear, and joins most of what links."""
        best = rows.groupBy("h", "e").agg(F.max_by(F.struct("node", "n", "label", "d", "s", "p"), F.struct("n", "node")).alias("x")).select("h", "e", "x.*")
        return _meets(rows, best, num, den)

    def all_pairs(rows: DataFrame) -> DataFrame:
        outside = rows.where("not inside")
        near = outside.where("near")
        return _meets(outside, rows.where("inside"), num, den).union(_meets(near, near, num, den)).distinct()

    rows = _mixed(_labelled(lists, labels), "h", "e")
    near = materialize_numbers(spark, _confirmed(first_pairs(rows), sets, num, den), "near")
    # The first links are followed for one step only: what they leave apart is proposed, and perhaps found linked, again.
    steps = _label_edges(near, labels)
    down = steps.union(steps.select("b", "a")).groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("_was"), F.least("a", "b").alias("_now"))
    moved = rows.join(down, F.col("label") == F.col("_was"), "left").withColumn("label", F.coalesce("_now", "label")).drop("_was", "_now")
    far = materialize_numbers(spark, _confirmed(all_pairs(_mixed(moved, "h", "e")), sets, num, den), "far")
    return _joined(spark, labels, near.union(far))


def _label_edges(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``a, b``: the labels that links join, where they differ."""
    left = _labelled(links.withColumnRenamed("a", "node"), labels).select(F.col("label").alias("a"), F.col("b").alias("node"))
    return _labelled(left, labels).select("a", F.col("label").alias("b")).where("a <> b").distinct()


def _joined(spark: SparkSession, labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label`` after more links: components of the labels, of which there are few."""
    edges = materialize_numbers(spark, _label_edges(links, labels), "joins")
    if not edges.take(1):
        return labels
    made = components(spark, edges).select(F.col("node").alias("_was"), F.col("label").alias("_now"))
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    every = labels.union(_labelled(ends, labels).select("node", "label")).distinct()
    return every.join(made, F.col("label") == F.col("_was"), "left").select("node", F.coalesce("_now", "label").alias("label"))


def _homes(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, k: int, slack: float) -> tuple[DataFrame, DataFrame]:
    """``doc_id, rid, n_shingles, node`` for every row, and ``node, component_id, label`` for every node."""
    ensure_importable(spark)
    rows = materialize_numbers(spark, sketches(docs, id_col, text_col, width, k), "sketches", outer=True)
    filled = rows.where("n_shingles > 0")
    classes = materialize_numbers(spark, filled.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min("rid").alias("rid"), F.min("doc_id").alias("least")), "classes")
    listed = materialize_numbers(spark, _listed(classes, k, num, den, slack), "lists")

    def read_sets(nodes: DataFrame) -> DataFrame:
        return _full_sets(docs, _with_ids(classes.select("node", "rid"), nodes.distinct(), "node", "left_semi"), id_col, text_col, width)

    heads = listed.groupBy("value").agg(F.max_by(F.struct("node", "n"), F.struct("weight", "node")).alias("head"), F.count("*").alias("c")).where("c > 1").select(F.col("value").alias("_v"), F.col("head.node").alias("h"), F.col("head.n").alias("hn"))
    led = materialize_numbers(spark, listed.join(heads, listed["value"] == heads["_v"]).select("value", "node", "n", "h", "hn"), "led")
    stars = led.where((F.col("node") != F.col("h")) & _size_fits("n", "hn", num, den)).select(F.greatest("node", "h").alias("a"), F.least("node", "h").alias("b")).distinct()
    pairs = materialize_numbers(spark, _estimated(materialize_numbers(spark, stars, "stars"), classes, k, num, den, slack), "pairs")
    unsure = pairs.where("not sure")
    sets = read_sets(unsure.select(F.col("a").alias("node")).union(unsure.select("b")))
    confirmed = _confirmed(unsure.select("a", "b"), materialize_numbers(spark, sets, "sets"), num, den)
    links = confirmed.union(pairs.where("sure").select("a", "b"))
    labels = _links_across(spark, led, components(spark, links), read_sets, num, den)

    homes = _labelled(classes.select("node", "least"), labels)
    named = homes.groupBy("label").agg(F.min("least").alias("component_id")).select(F.col("label").alias("_of"), "component_id")
    homes = homes.join(named, F.col("label") == F.col("_of")).select("node", "component_id", "label")
    return rows.select("doc_id", "rid", "n_shingles", "node"), materialize_numbers(spark, homes, "homes", outer=True)


def near_duplicate_groups(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, k: int = SKETCH, slack: float = SLACK
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each row of ``docs``.

    Documents link if 100 * |A and B| >= 85 * |A or B| (``numerator`` and ``denominator``). component_id is the
    smallest doc_id reachable; kept marks the row that carries it. Null, empty and blank texts have an empty set and
    link with nothing. Rows with a null id take part and never name a component. Repeated rows share their component;
    each that carries the smallest id is kept. Other columns of ``docs`` are ignored, whatever their names.
    """
    with temporary(spark), written_by_workers():
        rows, homes = _homes(spark, docs, id_col, text_col, width, numerator, denominator, k, slack)
    out = rows.withColumn("_node", F.when(F.col("n_shingles") > 0, F.col("node"))).join(homes.select(F.col("node").alias("_n"), "component_id"), F.col("_node") == F.col("_n"), "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def without_near_duplicates(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, k: int = SKETCH, slack: float = SLACK
) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: one of the smallest id, null ids last.

    Rows are told apart by id and text, so a null or repeated id makes no other text go. Rows without words stay, all
    of them. Rows that repeat the kept one in id and text go too, whatever else they hold.
    """
    with temporary(spark):
        with temporary(spark):
            rows, homes = _homes(spark, docs, id_col, text_col, width, numerator, denominator, k, slack)
        placed = rows.where("n_shingles > 0").join(homes.select(F.col("node").alias("_n"), "label"), F.col("node") == F.col("_n"))
        kept = placed.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "rid")).alias("of")).select(F.col("label").alias("_of"), F.col("of.rid").alias("stays"))
        judged = placed.join(kept, F.col("label") == F.col("_of"))
        gone = materialize_numbers(spark, judged.where("rid <> stays").select("rid").distinct(), "gone", outer=True)
        again = materialize_numbers(spark, judged.where("rid = stays").groupBy("rid").count().where("count > 1").select("rid"), "again", outer=True)
    keyed = docs.select(F.struct("*").alias("_doc"), _row_id(id_col, text_col).alias("rid"))
    left = _with_ids(keyed, gone, "rid", "left_anti")
    if again.take(1):
        left = _with_ids(left, again, "rid", "left_anti").unionByName(_with_ids(left, again, "rid", "left_semi").dropDuplicates(["rid"]))
    return left.select("_doc.*")
