"""Label-permutation null of many units at once, by blocks of a matrix product.

A cube's row holds one trial's values of a vector of units.  Spark spreads the vectors (`part`) and
their blocks over tasks; a task meets a part's blocks one after another, draws each block's
permutations from a hash of (realization, block, trial), and keeps only the sums of its own
realizations by units.  No permutation is stored, sent or broadcast, so draws and trials can grow.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIME = 2147483647
#: Trials that one matrix product takes, and bytes of coefficients that a task keeps for its next part.
PRODUCT_TRIALS, CACHE_BYTES = 256, 1 << 26


def mix(x: np.ndarray) -> np.ndarray:
    """One round of the hash; integers below 2**31 stay so, and products below 2**63."""
    return (x * x % PRIME * 48271 + 12345) % PRIME


def mix_sql(x: str) -> str:
    return f"(({x}) * ({x}) % {PRIME} * 48271 + 12345) % {PRIME}"


def order_keys(seed: int, draws: int, block: int, trials: np.ndarray) -> np.ndarray:
    """Keys by realization and trial; a realization's order of a block is that of its keys."""
    r = mix(np.arange(draws, dtype=np.int64) + seed)
    r = mix(mix((r + block) % PRIME))
    x = (r[:, None] + trials[None, :] * 7919) % PRIME
    return mix(mix(mix(x)))


def coefficients(seed: int, draws: int, block: int, trials: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row 0 for the labels as they are, then one row for each realization; class counts stay."""
    n, n1 = len(y), int(y.sum())
    out = np.full((draws + 1, n), -n1 / n)
    out[0, y == 1] = (n - n1) / n
    chosen = np.argsort(order_keys(seed, draws, block, trials), axis=1, kind="stable")[:, :n1]
    np.put_along_axis(out[1:], chosen, (n - n1) / n, axis=1)
    return out


def _values(column) -> np.ndarray:
    """List column as a matrix; null values become NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, float).reshape(len(column), -1)


class _Sums:
    """Sums of one part: coefficients by values, a bounded number of trials at a time."""

    def __init__(self, draws: int):
        self.draws, self.total, self.weight, self.left, self.right, self.n = draws, None, 0.0, [], [], 0

    def add(self, coef: np.ndarray, x: np.ndarray, weight: float) -> None:
        self.left.append(coef)
        self.right.append(x)
        self.weight += weight
        self.n += len(x)
        if self.n >= PRODUCT_TRIALS:
            self.flush()

    def flush(self) -> None:
        if self.n:
            more = np.concatenate(self.left, 1) @ np.concatenate(self.right)
            self.total = more if self.total is None else self.total + more
            self.left, self.right, self.n = [], [], 0


def _partial(seed: int, draws: int):
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        kept: OrderedDict = OrderedDict()
        size, at, sums, rows = 0, None, None, []

        def close_block() -> None:
            nonlocal size
            trials, y = np.concatenate([r[0] for r in rows]).astype(np.int64), np.concatenate([r[1] for r in rows])
            n1 = int(y.sum())
            if 0 < n1 < len(y):
                key = (at[2], trials.tobytes(), y.tobytes())
                if key not in kept:
                    kept[key] = coefficients(seed, draws, at[2], trials, y)
                    size += kept[key].nbytes
                    while size > CACHE_BYTES and len(kept) > 1:
                        size -= kept.popitem(last=False)[1].nbytes
                sums.add(kept[key], np.concatenate([r[2] for r in rows]), n1 * (len(y) - n1) / len(y))
            rows.clear()

        def close_part() -> list:
            sums.flush()
            if sums.total is None:
                return []
            cells = pa.array([sums.total.ravel()], pa.list_(pa.float64()))
            return [pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([sums.weight]), cells], names=["part", "weight", "cells"])]

        for batch in batches:
            names = batch.column("part").dictionary_encode().indices.to_numpy()
            salt, block, t, y = (batch.column(k).to_numpy() for k in ("salt", "b", "t", "y"))
            fresh = np.ones(len(names), bool)  # the first row of a block of a part
            fresh[1:] = (names[1:] != names[:-1]) | (salt[1:] != salt[:-1]) | (block[1:] != block[:-1])
            edges = np.append(np.flatnonzero(fresh), len(names))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                key = (batch.column("part")[i].as_py(), int(salt[i]), int(block[i]))
                if key != at:
                    if at is not None:
                        close_block()
                        if key[:2] != at[:2]:
                            yield from close_part()
                    if at is None or key[:2] != at[:2]:
                        sums = _Sums(draws)
                    at = key
                rows.append((t[i:j], y[i:j], _values(batch.column("xs").slice(i, j - i))))
        if at is not None:
            close_block()
            yield from close_part()

    return run


def _studentized(draws: int):
    """Each part's salted sums to effects, null moments, |z| exceedances and the part's maxima."""
    import pyarrow as pa

    def finish(part: str, weight: float, cells: np.ndarray):
        e = cells.reshape(draws + 1, -1) / weight
        m, s = e[1:].mean(0), e[1:].std(0, ddof=1)
        with np.errstate(all="ignore"):
            ok = s > 1e-12
            z = np.where(ok, np.round((e - m) / s, 9), np.nan)
            exceed = (np.abs(z[1:]) >= np.abs(z[0])).sum(0)
            top = np.where(ok, np.abs(z[1:]), 0).max(1)
        p = np.where(ok, (1 + exceed) / (draws + 1), 1.0)
        wrap = [pa.array([v], pa.list_(pa.float64())) for v in (e[0], m, s, z[0], p, top)]
        return pa.RecordBatch.from_arrays([pa.array([part]), *wrap], names=["part", "effect", "m", "s", "z", "p_raw", "top"])

    def run(batches: Iterator) -> Iterator:
        at, weight, cells = None, 0.0, None
        for batch in batches:
            for part, w, c in zip(batch.column("part").to_pylist(), batch.column("weight").to_pylist(), batch.column("cells"), strict=True):
                c = c.values.to_numpy()
                if part != at:
                    if at is not None:
                        yield finish(at, weight, cells)
                    at, weight, cells = part, w, c
                else:
                    weight, cells = weight + w, cells + c
        if at is not None:
            yield finish(at, weight, cells)

    return run


def _family(draws: int):
    """p-values among the family's maxima, one of which each realization has."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            p = []
            for z, top in zip(batch.column("z"), batch.column("family"), strict=True):
                z, top = np.abs(z.values.to_numpy()), np.sort(top.values.to_numpy())
                p.append(np.where(np.isnan(z), 1.0, (1 + draws - np.searchsorted(top, z, "left")) / (draws + 1)))
            names = ["part", "effect", "m", "s", "z", "p_raw"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p, pa.list_(pa.float64()))], names=[*names, "p_max"])

    return run


def label_null(cube: DataFrame, draws: int, seed: int = 3100, salts: int = 1) -> DataFrame:
    """Effects and p-values of every unit: part, place, effect, null_mean, null_sd, z, p_unadjusted, p_maxt.

    cube has part (string), b (block, a non-negative long), t (trial, likewise), y (0 or 1) and xs, the
    values of the part's units: arrays of one length within a part, of a length that a task can hold
    draws times.  A block is a bounded number of trials; its labels are permuted within it.  Blocks
    without both classes have no weight.  A unit with a null or NaN value, or whose null has no
    spread, has z null and p = 1.  An empty cube gives no rows.  Few parts of very many trials want
    `salts` above 1: it splits a part's blocks over that many tasks, whose sums are then added.
    """
    arrays = "effect array<double>, m array<double>, s array<double>, z array<double>, p_raw array<double>"
    rows = cube.select("part", F.pmod(F.hash("b"), F.lit(salts)).alias("salt"), F.col("b").cast("long").alias("b"), F.col("t").cast("long").alias("t"), F.col("y").cast("int").alias("y"), "xs")
    rows = rows.repartition(int(cube.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part", "salt").sortWithinPartitions("part", "salt", "b", "t")
    schema = f"part string, {arrays}, top array<double>"
    if salts == 1:  # a part's sums are whole where they arise
        sums, finish = _partial(seed, draws), _studentized(draws)
        parts = rows.mapInArrow(lambda batches: finish(sums(batches)), schema)
    else:
        sums = rows.mapInArrow(_partial(seed, draws), "part string, weight double, cells array<double>")
        parts = sums.repartition("part").sortWithinPartitions("part").mapInArrow(_studentized(draws), schema)
    parts = parts.repartition("part")  # both uses below read this exchange; without it the products run twice
    # one maximum for each realization: draws doubles in all, whatever the number of units
    tops = parts.select(F.posexplode("top").alias("r", "v")).groupBy("r").agg(F.max("v").alias("v")).agg(F.collect_list("v").alias("family"))
    done = parts.drop("top").crossJoin(F.broadcast(tops)).mapInArrow(_family(draws), f"part string, {arrays}, p_max array<double>")
    each = done.select("part", F.posexplode(F.arrays_zip("effect", "m", "s", "z", "p_raw", "p_max")).alias("place", "q"))
    known = lambda name: F.when(~F.isnan(f"q.{name}"), F.col(f"q.{name}"))
    return each.select(
        "part", F.col("place").cast("long").alias("place"), known("effect").alias("effect"), known("m").alias("null_mean"), known("s").alias("null_sd"),
        known("z").alias("z"), F.col("q.p_raw").alias("p_unadjusted"), F.col("q.p_max").alias("p_maxt"),
    )
