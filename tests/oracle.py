"""Compare a query with its SQL in DuckDB, as multisets of rows with columns sorted by name."""

import glob
import os

import duckdb
import pandas as pd


def rows_of(pdf: pd.DataFrame):
    pdf = pdf[sorted(pdf.columns)]
    norm = lambda v: None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else (v.item() if hasattr(v, "item") else v)
    clean = lambda v: repr(int(v)) if isinstance(v, float) and v == int(v) else repr(v)
    return sorted(tuple(clean(norm(v)) for v in r) for r in pdf.itertuples(index=False))


def duck(sql: str, sf: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con.execute(sql).df()


def assert_same(df, sql: str, sf: str) -> None:
    got, want = df.toPandas(), duck(sql, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want), (len(got), len(want))
    a, b = rows_of(got), rows_of(want)
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
