"""Run a registered query and its oracle SQL and compare them like the driver:
columns sorted by name, row count, and an order-insensitive value multiset."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return bool(v)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    return cols, rows


def duck_rows(con, sql):
    rel = con.sql(sql)
    cols = list(rel.columns)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in rel.fetchall()]
    return [cols[i] for i in order], rows


def compare(spark, con, fn, sql, sf_dir):
    scols, srows = spark_rows(fn(spark, sf_dir))
    dcols, drows = duck_rows(con, sql)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    problems = []
    if scols != dcols:
        problems.append(f"columns {scols} != {dcols}")
    if len(srows) != len(drows):
        problems.append(f"rows {len(srows)} != {len(drows)}")
    elif sorted(srows, key=key) != sorted(drows, key=key):
        a, b = sorted(srows, key=key), sorted(drows, key=key)
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        problems.append(f"values differ, e.g. {diff}")
    return len(srows), problems
