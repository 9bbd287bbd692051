"""A Spark result beside DuckDB's for the same tables."""

import glob
import os

import duckdb


def duck(sql: str, sf_dir: str):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[:-8]
        c.sql(f"create view {name} as select * from read_parquet('{p}')")
    r = c.sql(sql)
    return r.columns, r.fetchall()


def rows(columns, got):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in got), key=repr)


def agree(spark, query, sql: str, sf_dir: str = "/root/testdata/sf0.001") -> None:
    df = query(spark, sf_dir)
    columns, want = duck(sql, sf_dir)
    assert sorted(columns) == sorted(df.columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows(columns, want)
