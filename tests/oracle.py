"""Side-by-side comparison of a query with its SQL in DuckDB."""

import glob
import os

import duckdb
import numpy as np


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def comparable(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or isinstance(v, float) and np.isnan(v) else str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v))
        elif str(df[c].dtype).startswith(("float", "int", "bool", "Int")):
            df[c] = df[c].astype(float).round(9).map(lambda v: None if np.isnan(v) else str(v))
        else:
            df[c] = df[c].astype(str)
    return df.fillna("-").sort_values(list(df.columns)).reset_index(drop=True)


def agree(query, sql, spark, con, folder):
    mine, theirs = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert len(mine) == len(theirs)
    a, b = comparable(mine), comparable(theirs)
    assert a.equals(b), f"{(a != b).any(axis=1).sum()} rows differ"
