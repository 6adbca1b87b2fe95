"""Unicode normal forms, for which Spark has no built-in expression."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text as T


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else t)


def nfkc(c: Column) -> Column:
    return _nfkc(T.text(c))


def contains_term(c: Column, term: Column) -> Column:
    """Term match after both sides are brought to NFKC."""
    return T.contains_term(nfkc(c), nfkc(term))
