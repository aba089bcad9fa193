"""A query's rows against DuckDB's for its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        source = f"{f}/*.parquet" if f.is_dir() else str(f)
        con.execute(f"create view {f.stem} as select * from read_parquet('{source}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(names, found) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=lambda t: [(x is None, str(type(x)) if x is None else "", x if x is not None else 0) if not isinstance(x, (bool, float)) else (False, "", round(float(x), 3)) for x in t])


def difference(df, con, sql: str) -> str | None:
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, have = rows(names, got.fetchall()), rows(df.columns, [tuple(x) for x in df.collect()])
    if len(want) != len(have):
        return f"{len(have)} rows, the SQL has {len(want)}"
    for a, b in zip(have, want, strict=True):
        for x, y in zip(a, b, strict=True):
            same = x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
            if not same or isinstance(x, bool) != isinstance(y, bool):
                return f"{a} and {b}"
    return None
