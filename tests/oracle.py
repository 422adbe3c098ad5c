"""Compare a query with its SQL over one of the test folders."""

from __future__ import annotations

import datetime
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def plain(value):
    if value is None or isinstance(value, float) and value != value:
        return None
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return str(value.replace(tzinfo=None))
    return value


def same(spark, query, sql: str, folder: str = SMALL) -> None:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(folder):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    df = query(spark, folder)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=str)
    assert ours == theirs
