"""Protected spans: seven ordered kinds of patterns with arbitration between overlapping matches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Kinds in order of precedence.
KINDS = (
    ("url", r"https?://[^\s)>\]]+"),
    ("doi", r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+"),
    ("citation", r"\[(?:\d+|[A-Z][A-Za-z-]+(?:\s+et\s+al\.)?,?\s+\d{4})(?:\s*[,;]\s*(?:\d+|[A-Z][A-Za-z-]+(?:\s+et\s+al\.)?,?\s+\d{4}))*\]"),
    ("inline_math", r"(?<!\\)\$[^$\n]{1,240}(?<!\\)\$"),
    ("latex_command", r"\\[A-Za-z]+(?:\*|\[[^\]]{0,120}\]|\{[^{}]{0,160}\})*"),
    ("inline_code", r"`[^`\n]{1,200}`"),
    ("variable", r"\b(?:[A-Za-z]+_[A-Za-z0-9_]+|[A-Za-z]+[A-Z][A-Za-z0-9]*|[A-Z]{2,}[A-Za-z0-9]*)\b"),
)
_TRIMMED = ("url", "doi")


def find_spans(text: str, is_code: bool = False) -> list[tuple[str, str, int, int]]:
    """Kind, value, start and end: a match yields to accepted ones it overlaps and to an equal one of its kind."""
    if is_code:
        return [("code_block", text, 0, len(text))]
    taken: list[tuple[str, str, int, int]] = []
    values: set[tuple[str, str]] = set()
    for kind, pattern in KINDS:
        for m in re.finditer(pattern, text):
            value = m[0].rstrip(".,;:") if kind in _TRIMMED else m[0]
            free = all(m.end() <= a or z <= m.start() for _, _, a, z in taken)
            if free and (kind, value) not in values:
                values.add((kind, value))
                taken.append((kind, value, m.start(), m.end()))
    return taken


def protected_spans(blocks: DataFrame) -> DataFrame:
    """``doc_id, span_id, kind, value, block_id, page, start, end`` from blocks; ids count within the document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(d, p, b, pg, i, *s) for d, p, b, pg, t, e in f.itertuples(index=False) for i, s in enumerate(find_spans(t, e == "code"))]
            yield pd.DataFrame(out, columns=["doc_id", "pos", "block_id", "page", "nth", "kind", "value", "start", "end"]).astype({"page": "Int64"})

    found = blocks.select("doc_id", "pos", "block_id", F.col("page").cast("long"), "text", "element_type").mapInPandas(run, "doc_id long, pos int, block_id string, page long, nth long, kind string, value string, start long, end long")
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("pos", "nth"))
    return found.select("doc_id", F.format_string("PTS_%04d", number).alias("span_id"), "kind", "value", "block_id", "page", "start", "end")


def single_kind(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, nth, value`` for one pattern: no arbitration, so built-in expressions do."""
    found = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(pattern), 0)
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(found).alias("nth", "value"))
