"""Runs a registered query and its SQL on the same tables, and compares columns and rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

from cellgrid.plans.tables import TABLES


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, decimal.Decimal)) or isinstance(v, float) and not math.isnan(v):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.date().isoformat() if v.time() == datetime.time() else v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None if both agree, else what differs."""
    got = query(spark, sf_dir)
    mine = rows(got.columns, [tuple(r) for r in got.collect()])
    cursor = con.execute(sql)
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != want[0]:
        return f"columns {mine[0]} and {want[0]}"
    if len(mine[1]) != len(want[1]):
        return f"{len(mine[1])} and {len(want[1])} rows; {mine[1][:2]} and {want[1][:2]}"
    odd = [(a, b) for a, b in zip(mine[1], want[1], strict=True) if a != b]
    return f"{len(odd)} of {len(want[1])} rows differ, first {odd[0]} under {mine[0]}" if odd else None
