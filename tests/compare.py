"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def value(x):
    if pd.api.types.is_scalar(x) and pd.isna(x):
        return None
    if isinstance(x, float):
        x = round(x, 5)
        return int(x) if x == int(x) else x
    return x


def rows(df: pd.DataFrame):
    return [tuple(map(value, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]


def same(spark_df, con, sql):
    a, b = spark_df.toPandas(), con.sql(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} {sorted(b.columns)}"
    x, y = sorted(map(str, rows(a))), sorted(map(str, rows(b)))
    return "" if x == y else f"{len(x)} and {len(y)} rows, first differences {[p for p in zip(x, y, strict=False) if p[0] != p[1]][:2]}"
