"""A query's rows against DuckDB's, in any order."""

import glob
import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v if math.isinf(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return str(v)


def duck(d):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{d}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def check(spark, query, sql, d=SMALL):
    df = query(spark, d)
    result = duck(d).execute(sql)
    columns = [x[0] for x in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())
