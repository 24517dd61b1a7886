"""Tables in the folder that driver and executors share, where lineage ends and what is drawn once stays as it is."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def folder(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, else the checkpoint folder that is set, else (on local masters only) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="spark-scratch-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def _drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again; the files go when the driver ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    df.write.parquet(path)
    return spark.read.schema(StructType(df.schema.fields)).parquet(path)
