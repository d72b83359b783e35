"""Runs a query and its SQL over one folder of tables and tells how they differ."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str) -> pd.DataFrame:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c.sql(sql).df()


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    clean = lambda x: None if x is None or (isinstance(x, float) and x != x) or x is pd.NA else round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(clean(x) for x in r) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


def assert_same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    x, y = rows(a), rows(b)
    assert len(x) == len(y)
    assert x == y, next((p, q) for p, q in zip(x, y, strict=True) if p != q)
