"""Nulls whose realizations pick among sums: each block is scored once for every choice it has, and draws only pick.

A block's choices are its label allocations, its valid lags or the pairs that a trial can be taken from.  Their sums by
unit stay in the task that computed them; a realization's pick is an integer of a hash of (seed, realization, block), so no draw
multiplies trials, nothing is ordered, and all that a task sends is one sum for each realization and unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .label_null import PRIME, mix, mix_sql

#: Choices that a block's table holds at most; blocks with more are scored draw by draw.
TABLE = 4096
#: Trials of a block at most: so many that the number of allocations fits 62 bits.
MOST_TRIALS = 60
#: Bytes of picked sums that are added up at a time.
GATHER_BYTES = 1 << 25

#: What a scorer yields: key columns, choices, and a function from picks (draws x rows), their first row, and a unit (None: all of them) to sums by draw.
Scored = tuple[list[np.ndarray], int, Callable]


def stream(seed: int, draws: int, keys: list[np.ndarray], unit: int | None = None) -> np.ndarray:
    """Integers below PRIME by draw and row; with a unit they are that unit's own."""
    r = mix(np.arange(draws, dtype=np.int64) + seed)
    if unit is not None:
        r = mix(mix((r + 7919 * (unit + 1)) % PRIME))
    r = r[:, None]
    for key in keys:
        r = mix(mix((r + key[None, :] % PRIME * 31) % PRIME))
    return r


def stream_sql(source: str, seed: int, keys: list[str], carry: list[str], draws: int, units: int = 0, name: str = "hs") -> str:
    """The same as SQL steps, the last one `name`: r, (ui), the key and carried columns of table source, and h."""
    own, steps = ", ".join([*keys, *carry]), [f"{name}0 AS (SELECT r, {mix_sql(f'r + {seed}')} AS h FROM SERIES({draws}) s)"]
    extra = "r, "
    if units:
        steps.append(f"{name}1 AS (SELECT a.r AS r, i.r AS ui, (a.h + 7919 * (i.r + 1)) % {PRIME} AS h FROM {name}0 a CROSS JOIN SERIES({units}) i)")
        steps.append(f"{name}2 AS (SELECT r, ui, {mix_sql(mix_sql('h'))} AS h FROM {name}1)")
        extra = "r, ui, "
    last = f"{name}2" if units else f"{name}0"
    for k, key in enumerate(keys):
        if k:
            steps.append(f"{name}k{k} AS (SELECT {extra}{own}, (h + {key} % {PRIME} * 31) % {PRIME} AS h FROM {last})")
        else:
            steps.append(f"{name}k0 AS (SELECT {extra}{own}, (h + {key} % {PRIME} * 31) % {PRIME} AS h FROM {last} CROSS JOIN {source})")
        last = name if k == len(keys) - 1 else f"{name}m{k}"
        steps.append(f"{last} AS (SELECT {extra}{own}, {mix_sql(mix_sql('h'))} AS h FROM {name}k{k})")
    return ", ".join(steps)


def unranked(index: np.ndarray, n: int, n1: int) -> np.ndarray:
    """The index-th of the C(n, n1) allocations of n1 ones to n trials (rows of 0 and 1), those with early ones first."""
    out = np.zeros((len(index), n), np.int8)
    left, ones = index.astype(np.int64).copy(), np.full(len(index), n1)
    for i in range(n):
        with_one = np.array([comb(n - 1 - i, k - 1) if k else 0 for k in range(n1 + 1)], np.int64)[ones]
        one = left < with_one
        out[one, i] = 1
        left = np.where(one, left, left - with_one)
        ones = ones - one
    return out


def _gather(sums: np.ndarray) -> Callable:
    """Picks among sums (rows x choices x units)."""

    def take(index: np.ndarray, first: int, unit: int | None) -> np.ndarray:
        rows = np.arange(first, first + index.shape[1])
        if unit is not None:
            return sums[rows, index, unit].sum(1)
        step = max(1, GATHER_BYTES // (8 * len(rows) * sums.shape[2]))
        return np.concatenate([sums[rows, index[a : a + step]].sum(1) for a in range(0, len(index), step)])

    return take


def allocations(keys: list[np.ndarray], n: int, n1: int, x: np.ndarray) -> Scored:
    """Label allocations of blocks with n trials, n1 of them positive; x: rows x trials x units."""
    if n > MOST_TRIALS:
        raise ValueError(f"a block of {n} trials; at most {MOST_TRIALS} are possible")
    count = comb(n, n1)
    if count <= TABLE:
        coef = unranked(np.arange(count), n, n1) - n1 / n
        return keys, count, _gather(coef[None] @ x)

    def take(index: np.ndarray, first: int, unit: int | None) -> np.ndarray:
        total = sum((unranked(index[:, k], n, n1) - n1 / n) @ x[first + k] for k in range(index.shape[1]))
        return total if unit is None else total[:, unit]

    return keys, count, take


def choices(keys: list[np.ndarray], sums: np.ndarray) -> Scored:
    """Blocks with the same number of choices and their sums (rows x choices x units)."""
    return keys, sums.shape[1], _gather(sums)


def picked(df: DataFrame, score: Callable[..., Iterator[Scored]], names: list[str], draws: int, seed: int, shared: bool) -> DataFrame:
    """r, u, e: for each realization and unit the sum over blocks of what it picks.

    score turns an Arrow batch of blocks into groups of blocks with equally many choices.  shared: all units of a realization
    pick alike (labels); else every unit has draws of its own.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, any_rows = np.zeros((draws, len(names))), False
        for batch in batches:
            for keys, count, take in score(batch):
                step = max(1, GATHER_BYTES // (8 * draws))
                for a in range(0, len(keys[0]), step):
                    own = [k[a : a + step] for k in keys]
                    for unit in [None] if shared else range(len(names)):
                        h = stream(seed, draws, own, unit)
                        index = h % count if count <= TABLE else (h * PRIME + stream(seed + 1_000_003, draws, own, unit)) % count
                        if shared:
                            total += take(index, a, None)
                        else:
                            total[:, unit] += take(index, a, unit)
                any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(draws), len(names))), pa.array(names * draws), pa.array(total.ravel())], names=["r", "u", "e"])

    return df.mapInArrow(run, "r long, u string, e double").groupBy("r", "u").agg(F.sum("e").alias("e"))
