"""Comparison of a Spark query with its SQL in DuckDB."""

import glob
import os

import numpy as np
import pandas as pd


def database(folder):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, (float, np.floating)) and np.isnan(v):
            return "null"
        return repr(round(float(v), 6)).removesuffix(".0") if isinstance(v, (float, np.floating)) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False, name=None))
