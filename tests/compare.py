"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(v)
    if isinstance(v, int):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def compare(df, con, sql: str) -> tuple[bool, str, int]:
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    want = rows_of(cols, res.fetchall())
    got_cols = df.columns
    got = rows_of(got_cols, [tuple(r) for r in df.collect()])
    if sorted(cols) != sorted(got_cols):
        return False, f"columns {sorted(got_cols)} != {sorted(cols)}", len(got)
    if len(want) != len(got):
        return False, f"rows {len(got)} != {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} differ: cols {sorted(cols)} spark {bad[0][0]} duck {bad[0][1]}", len(got)
    return True, "ok", len(got)
