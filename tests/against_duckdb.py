"""Compare a query's rows with those of SQL run by DuckDB on the same tables."""

import math
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            place = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{place}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return f"[{', '.join(map(_cell, v))}]"
    if isinstance(v, dict):
        return f"[{', '.join(map(_cell, v.values()))}]"
    return str(v)


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(_cell(r[k]) for k in order) for r in rows)


def difference(df, sql: str, sf_dir: str) -> str:
    """What differs; empty if nothing does."""
    con = connection(sf_dir)
    found = con.execute(sql)
    names, expected = _sorted_rows([d[0] for d in found.description], found.fetchall())
    mine, rows = _sorted_rows(df.columns, df.collect())
    if mine != names:
        return f"columns {mine}, SQL has {names}"
    if rows == expected:
        return ""
    a, b = set(rows), set(expected)
    return f"{len(rows)} rows, SQL has {len(expected)}; only here {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
