"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if both agree; else what differs."""
    df = query(spark, sf_dir)
    cur = connect(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    kinds = dict(df.dtypes)
    alike = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    odd = {n: (kinds[n], str(d[1])) for n, d in zip(names, cur.description, strict=True) if str(d[1]) in ("HUGEINT",) or (str(d[1]) in alike and alike[str(d[1])] != kinds[n]) or str(d[1]).startswith("DECIMAL")}
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, cur.fetchall())
    if a != b:
        extra = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows; only in one: {extra}; types {odd}"
    return f"types {odd}" if odd else ""
