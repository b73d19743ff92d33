"""Compare a Spark result with a DuckDB result, whatever the order of rows and columns."""

import datetime
import decimal
import math

import duckdb

from sightline.views import TABLES


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return names, out.fetchall()


def same(df, sql, sf_dir):
    names, rows = duck_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    order = sorted(names)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    other = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rows), key=repr)
    assert len(mine) == len(other), (len(mine), len(other), mine[:3], other[:3])
    for a, b in zip(mine, other, strict=True):
        assert a == b, (order, a, b)
    return len(mine)
