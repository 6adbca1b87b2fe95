"""What a session needs before Python functions of this package run in it."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where it lies, as a cluster does after ``--py-files``."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    return spark


#: Rows that a table of rules, words or policies may have where it meets every row of another.
SMALL_ROWS = 20_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df``, to be broadcast, if it is counted to hold at most ``rows`` rows; else an error, as meeting every row of
    a large table with every row of another is no plan at all."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"a table that meets all rows of another has more than {rows} rows; split it")
    return F.broadcast(df)
