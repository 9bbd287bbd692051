"""A Spark result beside DuckDB's for the same tables."""

import glob
import os

import duckdb


def duck(sql: str, sf_dir: str):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    r = c.sql(sql)
    return r.columns, r.fetchall()


def rows(columns, got):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in got), key=repr)
