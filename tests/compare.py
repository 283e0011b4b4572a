"""Rows of a query against the rows of its SQL, columns by name, numbers to a tolerance."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        at = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/*.parquet')" if at.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x
    return x if isinstance(x, (int, str, bool, type(None))) else float(x) if hasattr(x, "as_tuple") else str(x)


def difference(df, con, sql: str, tolerance: float = 2e-6) -> str:
    """Empty if both agree, else what differs first."""
    got = [tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(_plain(r[i]) for i in order) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"

    def key(row):
        return tuple((x is None, str(type(x)) if not isinstance(x, (int, float)) else "", 0 if x is None else round(x, 3) + 0.0 if isinstance(x, float) else x) for x in row)

    near = 0
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        for x, y in zip(a, b, strict=True):
            if isinstance(x, float) and isinstance(y, (int, float)):
                if abs(x - y) > tolerance * max(1.0, abs(x)):
                    return f"{a} and {b}"
                near += x != y
            elif x != y:
                return f"{a} and {b}"
    return ""
