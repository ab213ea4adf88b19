"""Run a query's SQL in DuckDB over the same tables and compare whole results."""

import glob
import os

import duckdb


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)


def rows_of_frame(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(names).collect()), key=repr)
