"""Compares a query with its SQL twin on DuckDB."""

import glob
import os

import duckdb


def connection(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def text(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def same(spark, folder, query, sql):
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = sorted("|".join(text(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    cur = connection(folder).execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted("|".join(text(r[i]) for i in order) for r in cur.fetchall())
    assert cols == sorted(names)
    assert got == want
