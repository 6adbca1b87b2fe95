"""The corpus pipeline: language, near-duplicates, personal data, mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept. All but the last return
the columns of ``documents``; the last returns pieces of packed sequences.

An empty table passes through all stages as one. Null ids, sources and languages are kept as they are; a null text has
no language and goes in the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import langid, mixing, neardup, packing, pii
from quillspark.llm.common import delete, scratch_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, null ones too, and those of which no language stands out."""
    return langid.with_known_language(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked at a similarity of 0.8 or more, that of the smallest id; null ids last."""
    return neardup.without_near_duplicates(spark, docs, numerator=80, denominator=100, slack=0.3)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes ``[KIND]`` for every span of personal data; no document goes."""
    return pii.redacted(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out, keeps or repeats documents by their source's target; a null source is one of its own, the last."""
    return mixing.mixed_documents(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids; each repeat of a document is one of its own."""
    return packing.pack_sequences(spark, docs)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: Sketches, trained models and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = f"{scratch_dir(spark)}/quillspark/stage-{uuid.uuid4().hex}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:  # nothing reads the stage before any more
            delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
