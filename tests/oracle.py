"""Compares a Spark result with DuckDB's on the same tables."""

import glob
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v) if v is not None else None


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows) if None not in {x for r in rows for x in r} else sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def assert_same(frame, sql, sf_dir):
    got = [tuple(r) for r in frame.collect()]
    cur = connect(sf_dir).execute(sql)
    columns, want = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, got) == rows_of(columns, want)
