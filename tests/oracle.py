"""Compare a query's rows with DuckDB's on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def difference(df, con, sql: str, tolerance: float = 2e-6) -> str:
    """Empty if the rows are the same, floats within the tolerance."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} and {sorted(rel.columns)}"
    sides = []
    for cols, rows in ((df.columns, [tuple(r) for r in df.collect()]), (rel.columns, rel.fetchall())):
        at = [cols.index(n) for n in names]
        floats = [i for i in at if any(isinstance(r[i], float) for r in rows[:50])]
        sides.append(sorted(([r[i] for i in at if i not in floats], [r[i] for i in at if i in floats]) for r in rows))
    a, b = sides
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    for x, y in zip(a, b, strict=True):
        if x[0] != y[0]:
            return f"{x} and {y}"
        for u, v in zip(x[1], y[1], strict=True):
            if not (u == v or (u is not None and v is not None and math.isclose(u, v, rel_tol=1e-9, abs_tol=tolerance))):
                return f"{x} and {y}"
    return ""
