"""Runs a query and its SQL twin on the same tables and compares rows without order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck_rows(root: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(root).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def plain(rows, names, order):
    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6) + 0.0
        return x

    at = [names.index(c) for c in order]
    return sorted((tuple(value(r[i]) for i in at) for r in rows), key=repr)


def differs(spark_df, root: str, sql: str) -> str | None:
    """None if they agree, else what differs."""
    names, rows = duck_rows(root, sql)
    mine = [tuple(r) for r in spark_df.collect()]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    order = sorted(names)
    a, b = plain(mine, spark_df.columns, order), plain(rows, names, order)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if not all(u == v or (isinstance(u, (int, float)) and isinstance(v, (int, float)) and abs(u - v) <= 2e-6) for u, v in zip(x, y, strict=True))]
    return f"{len(bad)} rows, first {bad[0]}" if bad else None
