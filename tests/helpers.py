"""The registered queries against their SQL, on the driver's tables."""

import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def oracle(sql: str, sf: str = SF):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con.execute(sql).df()


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(None if pd.isna(x) else (round(x, 6) if isinstance(x, float) else x) for x in r) for r in frame[columns].itertuples(index=False))
