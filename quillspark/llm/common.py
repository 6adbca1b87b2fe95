"""Shared pieces: scratch tables, vectorised word hashing over Arrow buffers, connected components."""

from __future__ import annotations

import atexit
import itertools
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once; a single longer text is handled alone.
CHUNK_BYTES = 1 << 19
#: Bytes of rows sent to or from Python at once; a single longer row is sent alone.
ARROW_BYTES, ARROW_DEFAULT = 4 << 20, f"{64 << 20}b"

_own_scratch: list[str] = []


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package from where it lies, and keep Arrow batches small, so
    that long texts don't fill executors: a batch is held several times over, by the JVM and by the worker."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_DEFAULT) == ARROW_DEFAULT:  # set by nobody
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where none is set, a folder of this process serves a local session, whose threads all see it; on a cluster, where
    they wouldn't, that is an error.
    """
    for get in (spark.sparkContext.getConf().get, spark.conf.get):
        named = get("spark.checkpoint.dir", None)
        if named:
            return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="quillspark-"))
        atexit.register(shutil.rmtree, _own_scratch[0], ignore_errors=True)
    return "file://" + _own_scratch[0]


def materialize(spark: SparkSession, df: DataFrame, label: str, outer: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    Within ``temporary`` the table is deleted when that ends; with ``outer``, only when the one around it ends, if any.
    """
    path = _new_table(spark, label, outer)
    df.write.parquet(path)
    return _read_back(spark, df, path)


_by_workers: ContextVar[bool] = ContextVar("by_workers", default=False)


@contextmanager
def written_by_workers() -> Iterator[None]:
    """Within, ``materialize_numbers`` uses Python workers: up to two more an executor, of about 140 MB each."""
    token = _by_workers.set(True)
    try:
        yield
    finally:
        _by_workers.reset(token)


def materialize_numbers(spark: SparkSession, df: DataFrame, label: str, outer: bool = False) -> DataFrame:
    """``materialize`` for tables of numbers and lists of them; ``written_by_workers`` lets Python workers write its files.

    For each file that the JVM makes in a local or mounted folder, Hadoop starts three processes (``chmod``). Until such
    a process is another program it holds all memory of the JVM once more, so an executor of 2 GB counts as 4 or more.
    Operators of many short steps start hundreds. Other stores have no such processes and are written by Spark.

    Files get hidden names, and the driver uncovers those of the attempts whose result came, so files of failed or
    repeated tasks are never read.
    """
    ensure_importable(spark)
    path = _new_table(spark, label, outer)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    if not _by_workers.get() or uri.getScheme() != "file":
        df.write.parquet(path)
        return _read_back(spark, df, path)
    folder = uri.getPath()
    os.makedirs(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, writer = f"part-{uuid.uuid4().hex}.parquet", None
        for rows in _grouped(batches, ARROW_BYTES):
            writer = writer or pq.ParquetWriter(f"{folder}/_{name}", rows.schema)
            writer.write_table(rows)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"name": [name]})

    for row in df.mapInArrow(write, "name string").collect():
        os.rename(f"{folder}/_{row['name']}", f"{folder}/{row['name']}")
    return _read_back(spark, df, path)


def _grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of the batches in order, in tables of ``most`` bytes or one batch more."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _new_table(spark: SparkSession, label: str, outer: bool) -> str:
    path = f"{scratch_dir(spark)}/quillspark/{label}-{uuid.uuid4().hex}"
    scopes = _scopes.get()
    if outer:
        scopes = scopes[:-1]
    if scopes:
        scopes[-1].append(path)
    return path


def _read_back(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    if next(_written) % COLLECT_EVERY == 0:
        collect_garbage(spark)
    else:
        trim_native(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that are written between two collections of the driver's garbage.
COLLECT_EVERY = 8
_written = itertools.count(1)


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver's JVM give up the plans, broadcasts and shuffles of steps that have ended.

    Spark drops broadcasts and shuffle files only when their handles are collected, and a heap that has room isn't
    collected: operators of many short steps would fill all of it.
    """
    spark._jvm.System.gc()
    trim_native(spark)


def trim_native(spark: SparkSession) -> None:
    """Let the driver's C library give freed memory back to the system, as ``jcmd System.trim_native_heap`` does.

    The JVM compiles the code of every step anew, in memory that the library keeps once it is freed. JVMs that don't
    know the command (other systems, Java 17 before 17.0.9) go on without it.
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    objects, strings = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
    types, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    for i, x in enumerate((name, "systemTrimNativeHeap", objects, strings)):
        types[i], given[i] = jvm.java.lang.Class.forName(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")[i]), x
    # By its interface, as the server's class is none that others may call.
    invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types)
    with suppress(Py4JJavaError):
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables materialised within, so nothing read later may rest on them."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in own:
            delete(spark, path)
        collect_garbage(spark)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows of ``df`` with the smallest hashes of ``key``; all, if there are fewer.

    Rows are first filtered to a share of hashes that holds about twice as many, so what tasks send on stays near
    ``n`` rows in all, however many tasks there are.
    """
    total = df.count()
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 40))
    if total > 2 * n + 200:
        df = df.where(place < int((1 << 40) * (2 * n + 200) / total))
    return df.orderBy(place, key).limit(n)


# --- words over Arrow buffers -------------------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)  # odd, so it has an inverse modulo 2**64
_STEP_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MULT)
BYTES_FOLDED = _BYTE_VALUES[_FOLD]
BYTES_EXACT = _BYTE_VALUES


class Powers:
    """Powers of the hash step and of its inverse, grown as longer texts come."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= self.up.size:
            size = max(n + 1, 2 * self.up.size, CHUNK_BYTES + 1)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _STEP)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _STEP_INV)], dtype=np.uint64)
        return self.up, self.down


def text_chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows: first row, end row, their UTF-8 bytes, and row offsets into those. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + max_bytes, "right")) - 1)
        end = min(end, n)
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words ``[^\\x20\\x09-\\x0D]+`` of each row."""
    if not data.size:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~SPACE[data]
    filled = offs[:-1] < offs[1:]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[offs[:-1][filled]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offs[1:][filled] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hashes of byte spans; ``values`` maps bytes and decides whether case counts."""
    up, down = powers.upto(data.size)
    run = np.zeros(data.size + 1, np.uint64)
    np.cumsum(values[data] * up[: data.size], out=run[1:])
    return mix64((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULT)


def shingle_sets(texts: pa.Array, width: int, powers: Powers) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, end row, row offsets, and each row's sorted distinct shingle hashes as int64.

    Words are lower-cased in A-Z. A row of fewer words than ``width`` has its whole sequence as one shingle; a row
    without words has none.
    """
    for lo, hi, data, offs in text_chunks(texts):
        starts, ends, row = words(data, offs)
        rows = hi - lo
        count = np.bincount(row, minlength=rows)
        if not starts.size:
            yield lo, hi, np.zeros(rows + 1, np.int64), np.zeros(0, np.int64)
            continue
        w = span_hashes(data, starts, ends, BYTES_FOLDED, powers)
        first = np.r_[0, np.cumsum(count)][:-1]
        parts, owners = [], []
        if w.size >= width:
            h = w[: w.size - width + 1].copy()
            for k in range(1, width):
                h = h * _STEP + w[k : w.size - width + 1 + k]
            whole = row[: h.size] == row[width - 1 :]
            parts.append(mix64(h[whole]))
            owners.append(row[: h.size][whole])
        for r in np.flatnonzero((count > 0) & (count < width)):
            h = np.uint64(count[r])
            for x in w[first[r] : first[r] + count[r]]:
                h = np.uint64((int(h) * int(_STEP) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            parts.append(mix64(np.array([h ^ _MULT], np.uint64)))
            owners.append(np.array([r]))
        h, owner = np.concatenate(parts).view(np.int64), np.concatenate(owners)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(h.size, bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
        yield lo, hi, np.r_[0, np.cumsum(np.bincount(owner, minlength=rows))], h


# --- connected components -----------------------------------------------------------------------


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (a, b: long); label is the smallest node reachable.

    Alternating large-star and small-star rounds: each rewires every node's neighbours to its smallest one, so a
    round costs two aggregations over the edges, and chains shorten exponentially. Rounds end when the edges stay,
    which the order of nodes makes sure of.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("_u", "m").alias("m"))
        met = pairs.join(least, pairs["u"] == least["_u"])
        if large:
            return met.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v")))

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    with temporary(spark):
        now = materialize_numbers(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
        seen, was = signature(now), None
        while seen != was:
            both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = star(both, True)
            down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
            now = materialize_numbers(spark, star(down, False).where("u <> v").distinct(), "star")
            was, seen = seen, signature(now)
        ends = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).union(now.select(F.col("v"), F.col("v")).distinct())
        return materialize_numbers(spark, ends.groupBy("node").agg(F.min("label").alias("label")), "components", outer=True)
