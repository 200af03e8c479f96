"""Runs a query and its SQL twin and tells where they differ."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ("", "null")
    if isinstance(x, bool):
        return ("b", x)
    if isinstance(x, (int, float)):
        return ("n", round(float(x), 9) + 0.0)
    return ("s", str(x))


def compare(df, con, sql: str) -> str:
    """An empty string if equal in columns, types' kinds, rows and values."""
    got = df.toPandas()
    rel = con.sql(sql)
    want_cols, want_types = list(rel.columns), [str(t) for t in rel.types]
    want = rel.fetchall()
    if sorted(got.columns) != sorted(want_cols):
        return f"columns {sorted(got.columns)} and {sorted(want_cols)}"
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}
    kinds = {c: names.get(t, t) for c, t in df.dtypes}
    odd = {c: (kinds[c], t) for c, t in zip(want_cols, want_types, strict=True) if kinds[c] != t}
    order = sorted(want_cols)
    at = [want_cols.index(c) for c in order]
    a = sorted(tuple(cell(x.item() if hasattr(x, "item") else x) for x in r) for r in got[order].itertuples(index=False))
    b = sorted(tuple(cell(r[i]) for i in at) for r in want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return (f"types {odd} " if odd else "") + (f"{len(bad)} of {len(a)} rows differ, as {bad[0]}" if bad else "")
