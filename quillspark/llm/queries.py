"""Queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, imatch, langid, license, mixing, neardup, packing, pii, quality, urltree


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark, _table(spark, sf_dir, "embeddings"), each_row=True)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(spark, _table(spark, sf_dir, "documents"))


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(spark, _table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(spark, _table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_groups(spark, _table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(spark, _table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.filter_urls(spark, _table(spark, sf_dir, "pages"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_documents(spark, _table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(spark, _table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_inverted_multi_index, op2_mix_sources, op3_pack_sequences, op4_language_id, op5_quality, op6_near_duplicates, op7_licenses, op8_url_filter, op9_fingerprints, op10_personal_data)}

ORACLE_SQL: dict[str, str] = {"op2_mix_sources": mixing.ORACLE_SQL}
