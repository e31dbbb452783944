"""Compare a Spark result with DuckDB's, whatever the order of rows and the widths of numbers."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    try:
        f = round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)
    return int(f) if f == int(f) else f


def rows(names: list[str], values) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def assert_same(df, c: duckdb.DuckDBPyConnection, sql: str) -> None:
    out = c.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, out.fetchall())
