"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compare(df, sql: str, folder: str) -> str:
    """Empty if equal, else what differs."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = con.execute(sql)
    want = rows_of([c[0] for c in got.description], got.fetchall())
    have = rows_of(df.columns, df.collect())
    if want[0] != have[0]:
        return f"columns {have[0]} instead of {want[0]}"
    if len(want[1]) != len(have[1]):
        return f"{len(have[1])} rows instead of {len(want[1])}"
    return next((f"{h} instead of {w}" for w, h in zip(want[1], have[1], strict=True) if w != h), "")
