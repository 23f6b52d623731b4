"""Rows of a query and of its SQL, comparable."""

import glob

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = path.rsplit("/", 1)[1].removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(row[c] for c in columns)) for row in df.collect())


def sql_rows(con, sql):
    found = con.sql(sql)
    columns = sorted(found.columns)
    places = [found.columns.index(c) for c in columns]
    return columns, sorted(repr(tuple(row[p] for p in places)) for row in found.fetchall())
