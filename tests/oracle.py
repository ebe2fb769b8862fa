"""Comparing a query with its SQL."""

from pathlib import Path

import duckdb
import pandas as pd


def tables(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        if isinstance(v, float):
            return repr(round(v, 9)) if not float(v).is_integer() else str(int(v))
        return str(v)

    names = sorted(df.columns)
    return sorted(tuple(map(plain, r)) for r in df[names].astype(object).values.tolist())
