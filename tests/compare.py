"""Runs queries on both engines and compares rows, columns and values, order aside."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def plain(v):
    if v is None or isinstance(v, (str, bool, int)):
        return v
    if isinstance(v, float):
        return round(v, 9) if math.isfinite(v) else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v) if not hasattr(v, "as_tuple") else float(v)


def normal(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sf_dir: str, sql: str) -> str:
    columns, want = duck(sf_dir, sql)
    got = [tuple(r) for r in df.collect()]
    if sorted(columns) != sorted(df.columns):
        return f"columns {df.columns} and {columns}"
    a, b = normal(df.columns, got), normal(columns, want)
    if a == b:
        return ""
    sa, sb = set(map(repr, a)), set(map(repr, b))
    return f"{len(a)} and {len(b)} rows; only here {sorted(sa - sb)[:3]}; only there {sorted(sb - sa)[:3]}"
