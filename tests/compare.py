"""Compares a query with its SQL in DuckDB: same columns, same rows in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return tuple(sorted((k, _plain(v)) for k, v in x.asDict().items()))
    if type(x).__name__ == "Decimal":
        return _plain(float(x))
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return _plain(float(x)) if isinstance(x, int) and not isinstance(x, bool) else x


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def differences(spark, query, sql: str, sf_dir: str, con=None) -> list[str]:
    con = con or connect(sf_dir)
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    mine, theirs = sorted(df.columns), sorted(rel.columns)
    if mine != theirs:
        return [f"columns {mine} and {theirs}"]
    a = sorted((tuple(_plain(r[c]) for c in mine) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in mine]
    b = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if len(a) != len(b):
        return [f"{len(a)} and {len(b)} rows"]
    return [f"{x} and {y}" for x, y in zip(a, b) if x != y][:3]
