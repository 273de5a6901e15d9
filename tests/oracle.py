"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        c.execute(f"create view {name.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int) or (isinstance(v, float) and v.is_integer()):
        return str(int(v))
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, query, sql: str, sf_dir: str = DATA) -> int:
    df = query(spark, sf_dir)
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    c = tables(sf_dir)
    names = [r[0] for r in c.execute(f"describe {sql}").fetchall()]
    wanted = rows_of(names, c.execute(sql).fetchall())
    assert sorted(df.columns) == sorted(names)
    assert found == wanted
    return len(found)
