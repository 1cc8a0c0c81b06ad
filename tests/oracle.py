"""Runs a query and its SQL on the same tables and compares the rows, columns sorted by name."""

import math
import os

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def views(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        path = os.path.join(folder, f)
        c.execute(f"create view {f.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return str(v)


def compare(spark, query, sql, folder=FOLDER):
    df = query(spark, folder)
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    if sql is None:
        return mine, mine
    result = views(folder).execute(sql)
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == names
    at = [theirs.index(n) for n in names]
    return mine, sorted(tuple(plain(r[k]) for k in at) for r in result.fetchall())
