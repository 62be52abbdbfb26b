"""Comparing a query with its SQL, value by value."""

import glob
import os
from decimal import Decimal


def run_sql(sql, folder):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def plain(v):
    return None if v is None else round(float(v), 9) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v)


def assert_same(df, sql, folder):
    names, want = run_sql(sql, folder)
    columns = sorted(df.columns)
    assert columns == sorted(names)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in want), key=repr)
    assert got == want
