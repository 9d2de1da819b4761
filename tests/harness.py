"""Runs a registered query on Spark and its SQL on DuckDB and compares whole results."""

import datetime
import decimal
import math

import duckdb

from plotlink.catalog.views import BASE_TABLES


def connect(sf_dir):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, decimal.Decimal):
        return "decimal"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else "float"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return "time"
    return type(v).__name__


def _canon(v):
    k = _kind(v)
    if k == "float":
        return (k, repr(v + 0.0))
    if isinstance(v, (list, tuple)):
        return ("list", tuple(_canon(x) for x in v))
    return (k, str(v))


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_canon(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """None when equal, else a short description of the difference."""
    left = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    right = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(left)
    a, b = _rows(df.columns, left), _rows(names, right)
    if a == b:
        return None, len(left)
    only_a, only_b = sorted(set(a) - set(b), key=repr), sorted(set(b) - set(a), key=repr)
    show = lambda rs: "\n    ".join(
        str([f"{n}={v[1]}:{v[0]}" for n, v in zip(sorted(names), r)]) for r in rs[:3]
    )
    return (f"rows {len(a)} vs {len(b)}, only spark {len(only_a)}, only sql {len(only_b)}\n    {show(only_a)}\n  --\n    {show(only_b)}"), len(left)
