"""Correlations between many units' nulls by blocks of a Gram matrix, and their smallest, middle and largest off the diagonal.

A unit's realizations are one array, centred and scaled to length 1.  Units are dealt to blocks; every two blocks
meet in one task, which multiplies them.  Tasks send the extremes and a histogram; the entries near the median, and no
others, are sent in a second pass, so the median is exact and no pair of units is ever a row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import saved
from .quantiles import quantiles

#: Units in a block, and bins of the histogram over [-1, 1].
BLOCK, BINS = 512, 20_000


def _entries(left, right, same: bool) -> np.ndarray:
    product = np.clip(np.stack(left) @ np.stack(right).T, -1, 1)
    return product[np.triu_indices(len(product), 1)] if same else product.ravel()


def _bin(x: np.ndarray) -> np.ndarray:
    return np.minimum(((x + 1) / 2 * BINS).astype(int), BINS - 1)


def _meetings(units: DataFrame, block: int) -> DataFrame:
    """lo, hi, side, z: every unit once for each block that its own block meets."""
    count = F.lit(int(units.agg(F.max("i")).first()[0] or 0) // block)
    own = F.floor(F.col("i") / block).cast("int")
    rows = units.select(own.alias("own"), "z", F.explode(F.sequence(F.lit(0), count)).alias("other"))
    return rows.select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "z")


def summary(nulls: DataFrame, block: int = BLOCK) -> DataFrame:
    """n_units, n_pairs, low, median, high of the correlations between units.

    nulls: i (the unit's number, from 0), e (its realizations in one order, an array).  Units without spread are left out.
    """

    def scaled(batches):
        import pyarrow as pa

        for batch in batches:
            i, e = batch.column("i"), [np.asarray(x, float) for x in batch.column("e").to_pylist()]
            z = [x - x.mean() for x in e]
            size = np.array([np.sqrt((x**2).sum()) for x in z])
            keep = np.flatnonzero(size > 1e-12)
            yield pa.RecordBatch.from_arrays([i.take(pa.array(keep)), pa.array([z[k] / size[k] for k in keep], pa.list_(pa.float64()))], names=["i", "z"])

    units = saved(nulls.select(F.col("i").cast("long").alias("i"), "e").mapInArrow(scaled, "i long, z array<double>"), "units")
    meet = _meetings(units, block).groupBy("lo", "hi")

    def split(key, table):
        side, z = table.column("side").to_numpy(), table.column("z").to_pylist()
        first = [x for x, s in zip(z, side, strict=True) if not s]
        same = key[0] == key[1]
        return first, first if same else [x for x, s in zip(z, side, strict=True) if s], same

    def counted(key, table):
        import pyarrow as pa

        left, right, same = split(key, table)
        x = _entries(left, right, same) if left and right else np.zeros(0)
        at, n = np.unique(_bin(x), return_counts=True)
        ends = (float(x.min()), float(x.max())) if len(x) else (None, None)
        return pa.table({"bin": pa.array(at, pa.int64()), "n": pa.array(n, pa.int64()), "low": pa.array([ends[0]] * len(at), pa.float64()), "high": pa.array([ends[1]] * len(at), pa.float64())})

    histogram = meet.applyInArrow(counted, "bin long, n long, low double, high double").groupBy("bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    rows = sorted(histogram.collect(), key=lambda r: r["bin"])  # BINS rows at most
    total, found, so_far = sum(r["n"] for r in rows), [], 0
    for r in rows:  # the bins that hold the middle
        if so_far <= total // 2 and so_far + r["n"] > (total - 1) // 2:
            found.append((r["bin"], so_far, r["n"]))
        so_far += r["n"]
    wanted = [b for b, _, _ in found]

    def near(key, table):
        import pyarrow as pa

        left, right, same = split(key, table)
        x = _entries(left, right, same) if left and right else np.zeros(0)
        return pa.table({"x": x[np.isin(_bin(x), wanted)]})

    spark = nulls.sparkSession
    if not total:
        return spark.createDataFrame([(units.count(), 0, None, None, None)], "n_units long, n_pairs long, low double, median double, high double")
    before, inside = found[0][1], sum(n for _, _, n in found)
    rank = ((total - 1) / 2 - before) / max(inside - 1, 1)
    median = quantiles(meet.applyInArrow(near, "x double"), [], "x", {"median": rank})
    ends = (min(r["low"] for r in rows), max(r["high"] for r in rows))
    return median.select(F.lit(units.count()).alias("n_units"), F.lit(total).cast("long").alias("n_pairs"), F.lit(ends[0]).alias("low"), "median", F.lit(ends[1]).alias("high"))
