"""Compare a registered query with its oracle SQL in DuckDB: columns, row count and values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def canonical(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir.rstrip('/')}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def compare(spark, con, name: str, query, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    scols, srows = df.columns, [tuple(r) for r in df.collect()]
    if sql is None:
        return True, f"{len(srows)} rows (no oracle)"
    cur = con.execute(sql)
    dcols, drows = [d[0] for d in cur.description], cur.fetchall()
    if sorted(scols) != sorted(dcols):
        return False, f"columns spark={sorted(scols)} duckdb={sorted(dcols)}"
    a, b = canonical(scols, srows), canonical(dcols, drows)
    if a != b:
        sa, sb = set(a), set(b)
        return False, f"rows spark={len(a)} duckdb={len(b)} only-spark={list(sa - sb)[:2]} only-duckdb={list(sb - sa)[:2]}"
    return True, f"{len(a)} rows"
