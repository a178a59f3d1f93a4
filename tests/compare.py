"""Runs a query beside its SQL and compares values, rows in any order."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)

    def text(v):
        if v is pd.NA or isinstance(v, float) and v != v:
            return "null"
        if isinstance(v, float):
            return f"{v:.8g}"
        return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)

    return columns, sorted(tuple(text(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


def assert_same(spark_frame, sql_frame):
    assert rows(spark_frame) == rows(sql_frame)
