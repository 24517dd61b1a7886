"""Scans that check what they read, and sinks that can resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def delimited(spark: SparkSession, path: str, schema: str | StructType, sep: str = ",", allow_empty: bool = False) -> DataFrame:
    """A CSV or TSV table with header; a cell that does not fit its type fails the query.

    A table without rows is an error unless allow_empty; a missing path is one always.
    """
    df = spark.read.csv(path, schema=schema, sep=sep, header=True, mode="FAILFAST", enforceSchema=False)
    if not allow_empty and df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def checked(df: DataFrame, required: list[str], sizes: dict[str, int] | None = None, equal: dict[str, str] | None = None) -> DataFrame:
    """df, whose query fails on a row that breaks the contract.

    required columns must exist; arrays named in sizes have that length and finite values only;
    columns named in equal hold that value.  A null in any of them breaks the contract too.
    """
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    ok = F.lit(True)
    for name, n in (sizes or {}).items():
        x = F.col(f"`{name}`")
        finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        ok = ok & F.coalesce((F.size(x) == n) & finite, F.lit(False))
    for name, value in (equal or {}).items():
        ok = ok & F.coalesce(F.col(f"`{name}`") == value, F.lit(False))
    return df.where(F.when(ok, True).otherwise(F.raise_error(F.lit("a row breaks the contract of its table")).cast("boolean")))


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, after a check that no key repeats (null keys count as equal)."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key repeats: {[twice[0][k] for k in keys]}")
    return df


def pending(work: DataFrame, done_path: str, keys: list[str]) -> DataFrame:
    """Rows of work whose keys the table at done_path lacks; all of them if it does not exist yet."""
    spark = work.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(done_path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return work
    return work.join(spark.read.parquet(done_path).select(*keys).distinct(), keys, "left_anti")


def done(spark: SparkSession, path: str) -> bool:
    """Whether a table was written at path to its end, so that its step can be left out; what a broken write left does not count."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def append(df: DataFrame, path: str, by: list[str]) -> None:
    """Add df's rows to the Parquet table at path, in folders by the given columns.

    A folder is replaced as a whole and others stay, so an append that is tried again adds nothing twice; df has to hold all rows of the folders
    that it names.  What resumes by smaller keys takes them into `by`, such as a cell and a range of its repetitions.
    """
    if not by:
        raise ValueError("an append needs the columns of its folders")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV part files with header, written by as many tasks as df has partitions.

    A table without rows still leaves its header.
    """
    df.write.mode("errorifexists").csv(path, header=True)
