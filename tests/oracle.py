"""Run a registered query and its SQL twin on the same tables and compare the values."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute("SET threads=4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("num", float(v)) if abs(v) < 2**53 else ("int", v)
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return ("num", None if math.isnan(v) else v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return ("ts", str(v))
    if isinstance(v, str):
        return ("str", v)
    raise TypeError(f"nested value {type(v).__name__} in a query result")


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def spark_result(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def duck_result(con, sql):
    rel = con.execute(sql)
    return canonical([d[0] for d in rel.description], rel.fetchall())


def difference(got, want) -> str | None:
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}; first {got[1][:3]} / {want[1][:3]}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"row {a} != {b}"
    return None
