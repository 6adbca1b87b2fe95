"""Whole runs as plans: quality assurance of a translation, the residue audit, and the research record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, blocks, quality, research, spans, terms


def translation_issues(source_docs: DataFrame, translations: DataFrame, policies: DataFrame) -> DataFrame:
    """``block_id, rule, severity, title``: every check of a translation (doc_id, block_id, status, translation).

    Source documents become blocks and protected spans; blocks meet their translations by id; the checks' findings are
    unioned, so each is one branch of one plan.
    """
    b = blocks.build_blocks(source_docs)
    key = b.select("doc_id", "block_id", F.col("text").alias("source"))
    have = translations.select("doc_id", "block_id", "status", "translation")
    pairs = key.join(have, ["doc_id", "block_id"])
    one = lambda df, rule, severity, title: df.select("block_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), title.alias("title"))
    missing = align.missing(key, have, ["doc_id", "block_id"])
    twice = align.duplicated(have, ["doc_id", "block_id"])
    failed = have.where("status <> 'ok'")
    lost = terms.check_protected(pairs.select("block_id", "translation"), spans.protected_spans(b).select("block_id", "kind", "value"))
    parts = [
        one(missing, "omission", "high", F.lit("block missing")),
        one(twice, "addition", "medium", F.lit("block repeated")),
        one(failed, "omission", "high", F.lit("block failed")),
        terms.check_policies(pairs, policies).select("block_id", F.lit("term_policy").alias("rule"), "severity", "title"),
        one(terms.check_drift(pairs), "drift", "medium", F.col("rule")),
        one(terms.check_quantities(pairs), "quantity", "medium", F.lit("percentages differ")),
        lost.select("block_id", F.lit("protected").alias("rule"), "severity", F.concat(F.lit("lost "), "kind").alias("title")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def translation_report(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Issues by rule with a status, and the blocks to repair."""
    return quality.issue_rollup(issues, ["rule"]), quality.affected(quality.qa_checks(issues))


def research_status(bundles: DataFrame, questions: DataFrame, sources: DataFrame, claims: DataFrame, rounds: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All findings of research records, and each record's delivery status."""
    found = research.validate(bundles, questions, sources, claims, rounds)
    return found, research.delivery_status(bundles, reviews, found)
