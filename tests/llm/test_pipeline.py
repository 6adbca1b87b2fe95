import gc
import os
import re
import time
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid, neardup, packing, pii


def test_stages_hand_on_documents(spark, tmp_path, docs, rows):
    df = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null").dropDuplicates(["doc_id"])
    df = df.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" write me@here.org today"))).otherwise(F.col("text")))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    have = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = have.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = have
        out = stage(spark, have, str(tmp_path))
        if i < 4:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{i}.parquet")
        have = spark.read.parquet(f"{tmp_path}/{i}.parquet")
        ids = [r[0] for r in before.select("doc_id").collect()]
        now = [r[0] for r in have.select("doc_id").collect()]
        if i == 0:
            cut = langid.MIN_LEAD / len(langid.train(before).languages)
            assert set(ids) - set(now) == {r["doc_id"] for r in langid.identify_languages(spark, before).collect() if r["lang_pred"] == "und" or r["score"] < cut}
        if i == 1:
            assert sorted(now) == sorted(r["doc_id"] for r in neardup.near_duplicate_groups(spark, before, numerator=80, slack=0.3).where("kept").collect())
        if i == 2:
            assert sorted(now) == sorted(ids)
            assert not any(r["spans"] for r in pii.find_personal_data(spark, have).collect())
            assert all(n == len(t) for t, n in have.select("text", "n_chars").collect() if re.search(r"\[EMAIL\]", t or ""))
    assert have.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert have.agg(F.sum("length")).first()[0] > 0 and packing.WINDOW == 1024
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, have.collect()))


def test_stages_on_an_empty_table(spark, tmp_path, empty):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_on_nulls_and_repeated_rows(spark, tmp_path, docs):
    """Null ids, sources and languages, repeated rows and clashing column names pass; null and letterless texts go."""
    docs.withColumnRenamed("size", "_gone").write.parquet(f"{tmp_path}/documents.parquet")
    have = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, have, str(tmp_path))
        assert out.columns == have.columns
        out.write.parquet(f"{tmp_path}/{i}.parquet")
        have = spark.read.parquet(f"{tmp_path}/{i}.parquet")
    texts = [r[0] for r in have.select("text").collect()]
    assert texts and all(re.search(r"[^\W\d_]", t) for t in texts)
    assert corpus_pipeline.STAGES[-1][1](spark, have, str(tmp_path)).count() >= len(texts)


def test_mixing_moves_no_texts(spark, docs):
    """The plan of the mixing stage broadcasts the sources' table; documents go through no exchange."""
    from quillspark.llm import mixing

    plan = mixing.mixed_documents(spark, docs.where("doc_id >= 0"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 0


def test_garbage_of_ended_steps_goes(spark):
    """The driver's garbage is collected when temporary tables go, and after every few tables."""
    from quillspark.llm import common

    weak = spark._jvm.java.util.WeakHashMap()
    with common.temporary(spark):
        weak.put(1 << 40, 1)  # the number is boxed, and nothing else holds it
        for _ in range(common.COLLECT_EVERY):
            common.materialize(spark, spark.range(1), "made")
        assert weak.size() == 0
        weak.put(1 << 40, 1)
    assert weak.size() == 0


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="memory is read from /proc")
def test_freed_native_memory_goes(spark):
    """What the driver's JVM frees outside its heap goes back to the system, not only to the C library."""
    from quillspark.llm import common

    java = spark._jvm.java
    pid = java.lang.ProcessHandle.current().pid()

    def used() -> float:
        return int(re.search(r"RssAnon:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024

    common.collect_garbage(spark)
    held = java.util.ArrayList()
    for _ in range(1500):
        held.add(java.nio.ByteBuffer.allocateDirect(60_000))
    above = java.nio.ByteBuffer.allocateDirect(60_000)  # the library trims by itself only what lies above all else
    full = used()
    del held
    for _ in range(20):  # buffers are freed a while after they are collected
        gc.collect()
        common.collect_garbage(spark)
        if used() < full - 45:
            break
        time.sleep(0.2)
    assert used() < full - 45 and above.capacity() == 60_000


@pytest.mark.skipif(not os.path.exists("/proc/self/stat"), reason="faults are read from /proc")
def test_near_duplicates_start_no_processes(spark, docs):
    """A process that a JVM starts counts its memory twice for an instant, so the operator's many tables take none."""
    from quillspark.llm import common

    pid = spark._jvm.java.lang.ProcessHandle.current().pid()

    def ended() -> int:
        """Page faults of processes that the JVM started and that have ended."""
        return int(Path(f"/proc/{pid}/stat").read_text().rsplit(")", 1)[1].split()[8])

    with common.temporary(spark):  # what is started only once has been
        common.materialize(spark, docs.mapInArrow(lambda batches: batches, docs.schema), "made")
    before = ended()
    assert neardup.near_duplicate_groups(spark, docs).count() == docs.count()
    assert ended() - before < 500  # 24,000 with three processes a file; 130 are seen that no file has


def test_tables_of_numbers_come_back_whole(spark):
    """Types, nulls and empty parts come back; files of attempts whose result didn't come aren't read."""
    from quillspark.llm import common

    rows = [(i, i % 3 == 0, [i, None] if i % 5 else None, None if i % 7 else -i) for i in range(5000)]
    df = spark.createDataFrame(rows, "a long, b boolean, c array<long>, d int").repartition(5).where("a <> 1")
    with common.temporary(spark), common.written_by_workers():
        made = common.materialize_numbers(spark, df, "made")
        assert made.schema == df.schema and sorted(map(tuple, made.collect())) == [r for r in rows if r[0] != 1]
        folder = Path(made.inputFiles()[0].removeprefix("file:")).parent
        next(folder.glob("part-*")).rename(folder / "_part-of-a-failed-task.parquet")
        assert 0 < spark.read.parquet(str(folder)).count() < 4999
        none = common.materialize_numbers(spark, df.where("a < 0"), "made")
        assert none.schema == df.schema and none.collect() == []
    assert not folder.exists()
