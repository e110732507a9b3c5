"""Compare a registered query with its SQL in DuckDB: names, row counts and values, in any order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, int):
        return v
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bytes | bytearray):
        return bytes(v).hex()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    return str(v)


def rows_of(columns: list[str], rows) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None if they agree, or what differs first."""
    got = query(spark, sf_dir).toArrow()
    names, a = rows_of(got.column_names, zip(*(c.to_pylist() for c in got.columns), strict=True) if got.num_columns and got.num_rows else [])
    r = con.execute(sql)
    expected_names = [d[0] for d in r.description]
    expected_names, b = rows_of(expected_names, r.fetchall())
    if names != expected_names:
        return f"columns {names} and {expected_names}"
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"{x!r}"[:200] + " and " + f"{y!r}"[:200]
    return None
