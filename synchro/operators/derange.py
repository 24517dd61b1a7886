"""Derangements of any number of groups: a keyed bijection of 0..n-1 gives every group's partner by itself.

A realization's bijection is a swap-or-not shuffle: in each round a place and its mirror in a keyed number change sides or
not, by one keyed bit that both see.  It is a bijection of exactly n places for every n, so nothing walks, nothing is ordered and no task holds a
realization: groups are read twice, once to count each candidate's fixed points and once to give the partners of those without.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .label_null import PRIME, mix, mix_sql

#: A place is left as it was by all rounds with probability 2**-ROUNDS.
ROUNDS = 28
#: Candidates for each derangement wanted: a share of 1/3 to 1/2 of those of few groups, 1/e of those of many, have no fixed point.
CANDIDATES = 3.5
#: So many are looked at first.
USUAL = 2.9
#: Places that are moved at a time: arrays of them stay in a core's cache.
CELLS = 1 << 15


def fold(x: np.ndarray, high: np.ndarray) -> None:
    """x congruent modulo PRIME = 2**31 - 1, below 2**31 plus what stood above 31 bits; `high` is scratch."""
    np.right_shift(x, 31, out=high)
    x &= np.uint64(PRIME)
    x += high


def mixed(x: np.ndarray, high: np.ndarray) -> None:
    """`mix` but for the last reduction, in place: from below 2**31.1 to below 2**31.1."""
    x *= x
    fold(x, high)
    x *= np.uint64(48271)
    x += np.uint64(12345)
    fold(x, high)


def permuted(seed: int, candidates: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Where each candidate (rows) sends the places (columns)."""
    start = mix(mix(candidates.astype(np.int64) + seed))
    at = np.broadcast_to(places.astype(np.int64), (len(candidates), len(places))).copy()
    mirror, x, high = np.empty_like(at), np.empty(at.shape, np.uint64), np.empty(at.shape, np.uint64)
    for j in range(ROUNDS):
        key = mix(mix((start + 104729 * (j + 1)) % PRIME))[:, None]
        np.subtract(key % n, at, out=mirror)
        np.right_shift(mirror, 63, out=high.view(np.int64))  # -1 where it is negative
        high &= np.uint64(n)
        mirror += high.view(np.int64)
        np.maximum(at, mirror, out=x.view(np.int64))
        x *= np.uint64(7919)
        x += key.astype(np.uint64)
        fold(x, high)
        mixed(x, high)
        mixed(x, high)
        np.copyto(at, mirror, where=(x < PRIME // 2) | (x >= PRIME))  # x is below 2 * PRIME
    return at


def images(seed: int, candidates: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Where each candidate (columns) sends the places (rows), a part at a time."""
    out = np.empty((len(places), len(candidates)), np.int32 if n <= 1 << 31 else np.int64)
    for b in range(0, len(places), CELLS):
        own = places[b : b + CELLS]
        step = max(1, CELLS // len(own))
        for a in range(0, len(candidates), step):
            out[b : b + len(own), a : a + step] = permuted(seed, candidates[a : a + step], own, n).T
    return out


def derangements(groups: DataFrame, wanted: int, seed: int, families: int = 1) -> DataFrame:
    """f, r, g, h: `wanted` derangements of the groups for each of the families; a family's are its own.

    groups: g, and its place i from 0.  An error if there are fewer than `wanted` (a single group has none).
    """
    n = groups.count()
    if not n:
        return groups.sparkSession.createDataFrame([], "f int, r long, g long, h long")
    every = np.array(chosen(groups, n, wanted, seed, families)).ravel()

    def partners(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            places, g = batch.column("i").to_numpy(zero_copy_only=False), batch.column("g").to_numpy(zero_copy_only=False)
            step = max(1, CELLS // max(1, len(places)))
            for a in range(0, len(every), step):
                to = permuted(seed, every[a : a + step], places, n)
                k = np.repeat(np.arange(a, a + len(to)), len(places))
                yield pa.RecordBatch.from_arrays([pa.array((k // wanted).astype(np.int32)), pa.array(k % wanted), pa.array(np.tile(g, len(to))), pa.array(to.ravel())], names=["f", "r", "g", "to"])

    out = _spread(groups, "g", "i").mapInArrow(partners, "f int, r long, g long, to long")
    return out.join(groups.select(F.col("g").alias("h"), F.col("i").alias("to")), "to").select("f", "r", "g", "h")


def _spread(groups: DataFrame, *columns: str) -> DataFrame:
    # a number: candidates are work, however few bytes the groups are
    return groups.select(*columns).repartition(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), "i")


def chosen(groups: DataFrame, n: int, wanted: int, seed: int, families: int = 1) -> list[list[int]]:
    """The first `wanted` candidates of each family without a fixed point; groups: i, the places of n groups."""
    tried = ceil(CANDIDATES * wanted) + 64
    first = min(tried, ceil(USUAL * wanted) + 32)
    good = [[] for _ in range(families)]
    for low, high in ((0, first), (first, tried)):  # the others only where these are too few
        short = [f for f in range(families) if len(good[f]) < wanted]
        some = _fixed(groups, n, seed, np.concatenate([np.arange(f * tried + low, f * tried + high) for f in short])) if short and low < high else set()
        for f in short:
            good[f] += [c for c in range(f * tried + low, f * tried + high) if c not in some]
    for own in good:
        if len(own) < wanted:
            raise ValueError(f"{len(own)} derangements of {n} groups among {tried} permutations, {wanted} are wanted")
    return [own[:wanted] for own in good]


def _fixed(groups: DataFrame, n: int, seed: int, candidates: np.ndarray) -> set[int]:
    """Candidates that leave a place as it is."""

    def fixed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hit = np.zeros(len(candidates), bool)
        for batch in batches:
            places = batch.column("i").to_numpy(zero_copy_only=False)
            for b in range(0, len(places), CELLS):
                own, left = places[b : b + CELLS], np.flatnonzero(~hit)
                step = max(1, CELLS // len(own))
                for a in range(0, len(left), step):
                    c = left[a : a + step]
                    hit[c] = (permuted(seed, candidates[c], own, n) == own).any(1)
        yield pa.RecordBatch.from_arrays([pa.array(candidates[hit])], names=["c"])

    return {r["c"] for r in _spread(groups, "i").mapInArrow(fixed, "c long").distinct().collect()}  # numbers of candidates: a parameter bounds them


def derangements_sql(groups: str, wanted: int, seed: int, families: int = 1, name: str = "de") -> str:
    """The same as SQL steps over table `groups` (g); the last is `name` (f, r, g, h)."""
    tried = ceil(CANDIDATES * wanted) + 64
    steps = [
        f"{name}_g AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM {groups}) q)",
        f"{name}_0 AS (SELECT c, {mix_sql(mix_sql(f'c + {seed}'))} AS k, i, n, i AS pos FROM {name}_g CROSS JOIN (SELECT r AS c FROM SERIES({tried * families}) s) t)",
    ]
    for j in range(ROUNDS):
        key = mix_sql(mix_sql(f"(k + {104729 * (j + 1)}) % {PRIME}"))
        mirror = f"SELECT *, (key % n - pos + n) % n AS mirror FROM (SELECT *, {key} AS key FROM {name}_{j}) a"
        bit = mix_sql(mix_sql(f"(key + greatest(pos, mirror) * 7919) % {PRIME}"))
        steps.append(f"{name}_{j + 1} AS (SELECT c, k, i, n, CASE WHEN {bit} < {PRIME // 2} THEN mirror ELSE pos END AS pos FROM ({mirror}) b)")
    last = f"{name}_{ROUNDS}"
    steps += [
        f"{name}_o AS (SELECT c, c // {tried} AS f, row_number() OVER (PARTITION BY c // {tried} ORDER BY c) - 1 AS r FROM (SELECT c FROM {last} GROUP BY c HAVING sum(CASE WHEN pos = i THEN 1 ELSE 0 END) = 0) q)",
        f"{name} AS (SELECT CAST(o.f AS INT) AS f, o.r, a.g, b.g AS h FROM {last} p JOIN {name}_o o ON o.c = p.c AND o.r < {wanted} JOIN {name}_g a ON a.i = p.i JOIN {name}_g b ON b.i = p.pos)",
    ]
    return ", ".join(steps)
