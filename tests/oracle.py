"""Rows of a query and of its SQL, made comparable."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(normal(x) for x in v)
    return v


def sorted_rows(rows, columns, wanted):
    at = [columns.index(c) for c in wanted]
    return sorted((tuple(normal(r[i]) for i in at) for r in rows), key=lambda r: tuple(map(str, r)))


def differences(df, con, sql) -> str | None:
    wanted = sorted(df.columns)
    ours = sorted_rows(df.collect(), df.columns, wanted)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != wanted:
        return f"columns {wanted} and {sorted(names)}"
    theirs = sorted_rows(result.fetchall(), names, wanted)
    if ours == theirs:
        return None
    return f"{len(ours)} and {len(theirs)} rows; first difference {next(((a, b) for a, b in zip(ours, theirs, strict=False) if a != b), None)}"[:800]
