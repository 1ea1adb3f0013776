"""Compares a query's rows with those of its SQL in DuckDB."""

import glob
import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    return v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=str)


def connect(sf_dir):
    con = duckdb.connect()
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{src}'")
    return con


def rows_of_sql(con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in got.fetchall()), key=str)
