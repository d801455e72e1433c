"""Comparison of queries with their SQL on the supplied tables."""

import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.8g}"
    return [plain(x) for x in v] if isinstance(v, list) else v


def assert_equal(spark, run, sql):
    got = run(spark, DATA)
    cursor = connection().execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    mine = sorted(repr([plain(r[n]) for n in order]) for r in got.collect())
    theirs = sorted(repr([plain(r[names.index(n)]) for n in order]) for r in cursor.fetchall())
    assert mine == theirs
