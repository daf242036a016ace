"""Exact comparison of a query's Spark rows with the rows of its SQL."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return 0.0 if v == 0 else v
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cols, rows = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    names, types = [d[0] for d in cur.description], [str(d[1]) for d in cur.description]
    want_cols, want = _rows(names, cur.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    big = [n for n, t in zip(names, types) if "HUGEINT" in t or "DECIMAL" in t]
    if big:
        return f"SQL types to cast: {big}"
    if len(rows) != len(want):
        return f"{len(rows)} rows != {len(want)}"
    bad = [(a, b) for a, b in zip(rows, want) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ, columns {cols}, first: {bad[0]}"
    if not rows:
        return "no rows on either side"
    return None
