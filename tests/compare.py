"""A query's rows against those of its SQL on the same tables."""

import datetime
import math
import os

import duckdb

DATA = os.environ.get("FOLIOFORGE_TESTDATA", "/root/testdata/sf0.001")


def connection(data=DATA):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(data):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def assert_same(spark, query, sql, data=DATA):
    df = query(spark, data)
    got = connection(data).sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(got.columns)
    at = [got.columns.index(c) for c in columns]
    mine = sorted(str([plain(v) for v in r]) for r in df.select(*columns).collect())
    theirs = sorted(str([plain(r[i]) for i in at]) for r in got.fetchall())
    assert mine == theirs
