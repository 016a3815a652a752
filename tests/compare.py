"""Rows of a Spark query against those of its SQL in DuckDB."""

import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        path = f"{folder}/{f}/*.parquet" if os.path.isdir(f"{folder}/{f}") else f"{folder}/{f}"
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.6g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v)
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.6g}")
    return v


def same_rows(df, c: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[x]) for x in columns)) for r in df.collect())
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(x) for x in columns]
    theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
    assert ours == theirs
