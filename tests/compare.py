"""Runs queries beside their SQL and compares all rows."""

from __future__ import annotations

import glob
import os
import sys

import duckdb
import pandas as pd


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows_of(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def clean(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(clean(v) for v in row) for row in frame.astype(object).itertuples(index=False)), key=repr)


def differs(spark, con, query, sql: str, sf_dir: str) -> str | None:
    a, b = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    x, y = rows_of(a), rows_of(b)
    if x == y:
        return None
    odd = [(p, q) for p, q in zip(x, y) if p != q]
    return f"{len(x)} and {len(y)} rows; first difference {odd[:1]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from conftest import session

    spark, sf = session(), sys.argv[1]
    con = duck(sf)
    for name, sql in entry.oracle_sql().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            print(name, differs(spark, con, entry.queries()[name], sql, sf) or "ok", flush=True)
        except Exception as e:  # noqa: BLE001
            print(name, "ERROR", str(e)[:300].replace("\n", " "), flush=True)
