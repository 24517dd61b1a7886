"""Running sums and ranks over a whole table, or within groups of any size, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """df with the running sum of each expression in the given order, its own row included; within the groups of `by` if given.

    Rows go to ranges of (by, order) once and are written with their range's number, so whatever reads them sees
    the same ranges; sums run within a range and start from the totals of those before, one row a range and
    group.  A null counts as nothing.  order must be total, or rows that tie are summed in any order.
    """
    by = by or []
    ranged = df.withColumns({f"__{name}": x for name, x in sums.items()}).repartitionByRange(*by, *order)
    ranged = saved(ranged.withColumn("__range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("__range", *by).agg(*(F.sum(f"__{name}").alias(f"__{name}") for name in sums))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("__range").alias("__at"), *(F.col(c).alias(f"__by{k}") for k, c in enumerate(by)), *(F.coalesce(F.sum(f"__{name}").over(before), F.lit(0)).alias(f"__start_{name}") for name in sums))
    same = F.col("__range") == F.col("__at")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{k}"))
    out = ranged.join(totals if by else F.broadcast(totals), same)  # without groups there is one row a range
    out = out.withColumns({name: F.coalesce(F.sum(f"__{name}").over(within), F.lit(0)) + F.col(f"__start_{name}") for name in sums})
    return out.select(*df.columns, *sums)


def numbered(df: DataFrame, order: list[Column], name: str = "i", by: list[str] | None = None) -> DataFrame:
    """df with each row's place in the order, from 0, in the column `name`."""
    return running(df, order, {name: F.lit(1).cast("long")}, by).withColumn(name, F.col(name) - 1)
