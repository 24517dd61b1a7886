"""Cluster bootstrap by counts: how often each group is in each resample, times the groups' values, as matrix products.

A resample has n slots, each an integer of a hash of (seed, resample, slot) modulo the n groups.  A task has a block of groups
and a block of resamples; it goes through the slots a part at a time, counts its own groups, and multiplies the counts
with their values.  No slot is a row and nothing is joined; a task sends one sum for each resample and unit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .derange import fold, mixed
from .draws import stream
from .label_null import PRIME

#: Groups, and resamples, of a task; slots that are looked at a time.
GROUPS, RESAMPLES, SLOTS = 1 << 16, 1_000, 1 << 21
#: Rows of a population that a task holds, and cells (resamples by slots) that stay in a core's cache.
HELD, CELLS = 1 << 20, 1 << 16


def counts(seed: int, first: int, draws: int, n: int, low: int, size: int) -> np.ndarray:
    """How often groups low .. low + size - 1 of n are in each of the resamples first .. first + draws - 1."""
    out = np.zeros((draws, size), np.int64)
    step = max(1, SLOTS // draws)
    for a in range(0, n, step):
        slots = np.arange(a, min(n, a + step), dtype=np.int64)
        to = stream(seed + first, draws, [slots]) % n - low
        inside = (to >= 0) & (to < size)
        rows = np.broadcast_to(np.arange(draws)[:, None], to.shape)[inside]
        out += np.bincount(rows * size + to[inside], minlength=draws * size).reshape(draws, size)
    return out


def resampled(groups: DataFrame, n: int, names: list[str], draws: int, seed: int) -> DataFrame:
    """r, u, e: weighted means of the resamples.

    groups: i (from 0 to n - 1), xs (for each unit of names: value times weight, then the weights; 0 where a unit lacks the group).
    """

    def run(key, table):
        import pyarrow as pa

        block, first = key[0].as_py(), key[1].as_py() * RESAMPLES
        i = table.column("i").to_numpy() - block * GROUPS
        x = np.zeros((int(i.max()) + 1, 2 * len(names)))
        x[i] = np.stack(table.column("xs").to_pylist())
        k = min(RESAMPLES, draws - first)
        total = counts(seed, first, k, n, block * GROUPS, len(x)) @ x
        half = len(names)
        return pa.table({"r": np.repeat(np.arange(first, first + k), half), "u": names * k, "x": total[:, :half].ravel(), "w": total[:, half:].ravel()})

    every = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // RESAMPLES))).alias("part")
    rows = groups.select("i", "xs", F.floor(F.col("i") / GROUPS).cast("long").alias("block"), every)
    sums = rows.groupBy("block", "part").applyInArrow(run, "r long, u string, x double, w double")
    return sums.groupBy("r", "u").agg((F.sum("x") / F.sum("w")).alias("e"))


def _slots(start: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
    """`stream` of the slots after the keys before them (start, by resample), modulo n."""
    x = start[:, None].astype(np.uint64) + (slots % PRIME * 31).astype(np.uint64)
    high = np.empty_like(x)
    fold(x, high)
    mixed(x, high)
    mixed(x, high)
    np.subtract(x, np.uint64(PRIME), out=x, where=x >= PRIME)
    return (x.astype(np.uint32) % np.uint32(n)).astype(np.int64) if n < PRIME else x.astype(np.int64)


def means(rows: DataFrame, draws: int, seed: int, held: int = HELD) -> DataFrame:
    """pop, r, m: means of resamples of each population.

    rows: pop (a population's number), i (from 0 within it), n (its rows), x.  A population is resampled from its own rows only.
    A task has `held` of them and goes through all slots, so slots are looked at once by populations of up to so many rows.
    """

    def run(key, table):
        import pyarrow as pa

        pop, block, first = key[0].as_py(), key[1].as_py(), key[2].as_py() * RESAMPLES
        i, n = table.column("i").to_numpy() - block * held, table.column("n")[0].as_py()
        x = np.zeros(int(i.max()) + 1)
        x[i] = table.column("x").to_numpy()
        k = min(RESAMPLES, draws - first)
        start, out, step = stream(seed + first, k, [np.array([pop])])[:, 0], np.zeros(k), max(1, CELLS // k)
        for a in range(0, n, step):
            to = _slots(start, np.arange(a, min(n, a + step), dtype=np.int64), n)
            if len(x) == n:
                out += x.take(to).sum(1)
                continue
            to -= block * held
            inside = (to >= 0) & (to < len(x))
            out += np.where(inside, x[np.where(inside, to, 0)], 0.0).sum(1)
        return pa.table({"pop": np.full(k, pop), "r": np.arange(first, first + k), "s": out / n})

    every = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // RESAMPLES))).alias("part")
    rows = rows.select("pop", "i", "n", "x", F.floor(F.col("i") / held).cast("long").alias("block"), every)
    return rows.groupBy("pop", "block", "part").applyInArrow(run, "pop long, r long, s double").groupBy("pop", "r").agg(F.sum("s").alias("m"))
