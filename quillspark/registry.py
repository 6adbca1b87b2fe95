"""Where queries over the test tables are registered with their DuckDB twins, and made texts that both engines share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def picked(key: str, values: Sequence[str | None]):
    """The value that a key picks, in turn: what operators on free text are given for every row of a table."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def picked_sql(key: str, values: Sequence[str | None]) -> str:
    return f"([{', '.join(quoted(v) for v in values)}]::VARCHAR[])[(({key}) % {len(values)} + 1)::INT]"


def cases(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: Sequence[str | None]) -> DataFrame:
    """``key`` and ``s``, ``t``, ... picked by it, for every row of a table."""
    df = table(spark, sf_dir, name)
    return df.select(F.col(key), *[picked(key, c).alias(n) for n, c in zip("stuv", columns)])


def cases_sql(name: str, key: str, *columns: Sequence[str | None]) -> str:
    return f"(SELECT {key}, {', '.join(f'{picked_sql(key, c)} AS {n}' for n, c in zip('stuv', columns))} FROM {name})"
