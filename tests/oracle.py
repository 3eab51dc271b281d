"""Runs a query and its SQL on the same tables and compares the rows."""

import os

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        p = f"{sf_dir}/{t}"
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{p + ('/*.parquet' if os.path.isdir(p) else '')}')")
    return con


def _cell(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, str):
        return v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return str(v)
    if isinstance(v, (int, float)):
        return None if v != v else round(float(v), 8) + 0.0
    return v


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(_cell(v) for v in r) for r in df.itertuples(index=False)), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def same(spark, con, sf_dir: str, query, sql: str) -> None:
    a, b = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
