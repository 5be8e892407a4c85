"""A query and its SQL side by side, as the driver compares them."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return str([value(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(value(r[c]) for c in cols) for r in df.collect())


def oracle(directory, sql):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{directory}/*.parquet"):
        where = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{where}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted(tuple(value(r[i]) for i in at) for r in got.fetchall())
