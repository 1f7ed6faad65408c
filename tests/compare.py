"""Value-hash style comparison of a Spark result with its SQL on DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def difference(df, con, sql):
    """Empty string when equal, else a short description."""
    cols_s, rows_s = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols_d, rows_d = rows_of([c[0] for c in cur.description], cur.fetchall())
    if cols_s != cols_d:
        return f"columns {cols_s} vs {cols_d}"
    if len(rows_s) != len(rows_d):
        return f"rows {len(rows_s)} vs {len(rows_d)}"
    if not rows_s:
        return "no rows"
    bad = [(a, b) for a, b in zip(rows_s, rows_d) if a != b]
    return f"{len(bad)} of {len(rows_s)} rows differ, first {bad[0]}" if bad else ""
