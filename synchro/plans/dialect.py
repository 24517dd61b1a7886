"""One query text for two engines: Spark runs it over DataFrames, DuckDB is the oracle's engine.

`{name}` stands for a table.  A few constructs differ by engine and are written as markers:
SERIES(n) is a table of r = 0..n-1, UNROLL(table, key, array) one of (key, i, x), and
PCT(x, q) an exact, interpolated percentile, TEXTS(x) a group's few values as
sorted texts joined by commas, sha256_of(text) a hex digest.  SPREAD(columns) after SELECT spreads
few rows, which draws are about to multiply, over all shuffle partitions (adaptive execution would
put them into one); it stands for nothing in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def spark_text(sql: str, partitions: int) -> str:
    sql = re.sub(r"SPREAD\(([^)]*)\)", rf"/*+ REPARTITION({partitions}, \1) */", sql)
    sql = re.sub(r"SERIES\((\d+)\)", r"(SELECT id AS r FROM range(\1))", sql)
    sql = re.sub(r"UNROLL\((\S+), (\w+), (\w+)\)", r"(SELECT \2, i, CAST(x AS DOUBLE) AS x FROM \1 LATERAL VIEW posexplode(\3) e AS i, x)", sql)
    sql = re.sub(r"TEXTS\((\w+)\)", r"array_join(array_sort(collect_list(CAST(\1 AS STRING))), ',')", sql)
    return sql.replace("PCT(", "percentile(").replace("sha256_of(text)", "sha2(text, 256)")


def duckdb_text(sql: str) -> str:
    sql = re.sub(r"SPREAD\([^)]*\)", "", sql)
    sql = re.sub(r"\{(\w+)\}", r"\1", sql)
    sql = re.sub(r"SERIES\((\d+)\)", r"(SELECT range AS r FROM range(\1))", sql)
    sql = re.sub(r"UNROLL\((\S+), (\w+), (\w+)\)", r"(SELECT \2, generate_subscripts(\3, 1) - 1 AS i, CAST(unnest(\3) AS DOUBLE) AS x FROM \1)", sql)
    sql = re.sub(r"TEXTS\((\w+)\)", r"string_agg(CAST(\1 AS VARCHAR), ',' ORDER BY CAST(\1 AS VARCHAR))", sql)
    return sql.replace("PCT(", "quantile_cont(").replace("sha256_of(", "sha256(")


def run(spark: SparkSession, sf_dir: str, sql: str, **given: DataFrame) -> DataFrame:
    """The query over the tables of sf_dir that it names, and the given ones."""
    named = {t for t in TABLES if "{" + t + "}" in sql}
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.sql(spark_text(sql, partitions), **given, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in named})
