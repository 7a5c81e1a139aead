"""Comparison of a Spark query with its SQL in DuckDB, rows as a bag, columns by name."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata"


def plain(v):
    if isinstance(v, (np.ndarray, list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if v is None or v is pd.NaT or v is pd.NA:
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return "null" if v != v else f"{v:.6f}".rstrip("0").rstrip(".")
    return str(v)


def bag(frame):
    columns = sorted(frame.columns)
    return columns, sorted("|".join(plain(v) for v in row) for row in frame[columns].itertuples(index=False))


def expected(sql, sf):
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{DATA}/{sf}/{t}.parquet'")
        return con.execute(sql).df()
