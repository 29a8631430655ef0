"""Compares a query's rows with DuckDB's, in any order."""

import datetime
import decimal
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    db = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def differences(df, sql, folder):
    """Empty if columns and rows agree."""
    found = connect(folder).sql(sql)
    names = sorted(found.columns)
    if names != sorted(df.columns):
        return [f"columns {sorted(df.columns)}, in SQL {names}"]
    at = [found.columns.index(c) for c in names]
    ours = Counter(tuple(map(plain, row)) for row in df.select(*(f"`{c}`" for c in names)).collect())
    theirs = Counter(tuple(plain(row[i]) for i in at) for row in found.fetchall())
    return [("ours", *x) for x in list((ours - theirs).items())[:3]] + [("SQL", *x) for x in list((theirs - ours).items())[:3]]
