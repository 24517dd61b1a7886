"""Sums over surrogate partners, without a table of who meets whom.

Every realization sends each place to a partner by a keyed bijection (`derange`), so a task finds the partners of its own places
by itself.  A task has a family of realizations and a range of places; the partners' rows pass by it in the order of their
places, some SEGMENT bytes at a time, and what it sends is one sum for each realization.  So neither pairs of groups nor
draws are rows: what moves is the partners' rows, once for each range of places, and a range grows to PLACES before there are more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import derange, phase

#: Places of a task at most (at least FEW), and bytes of partners' rows that it holds at a time.
PLACES, FEW, SEGMENT = 1 << 13, 64, 32 << 20
#: Cells that are scored at a time, and mine that meet all partners in one matrix product.
CELLS, PRODUCT = 1 << 16, 64


class Rows:
    """Places, and arrays end to end with each row's first element."""

    def __init__(self, batches: list):
        self.i = np.concatenate([b.column("i").to_numpy(zero_copy_only=False) for b in batches])
        for c in ("kw", "x"):
            flat = [b.column(c).flatten().to_numpy(zero_copy_only=False) for b in batches]
            size = np.concatenate([_sizes(b.column(c)) for b in batches])
            setattr(self, c, np.concatenate(flat).astype(float))
            setattr(self, f"{c}_at", np.concatenate(([0], np.cumsum(size))))

    def __len__(self) -> int:
        return len(self.i)


def _sizes(column) -> np.ndarray:
    size = np.diff(column.offsets.to_numpy())
    return np.where(column.is_null().to_numpy(zero_copy_only=False), 0, size) if column.null_count else size


#: Given the places' own rows, those of partners, and for a place the partners' rows by realization (-1: none there), yields
#: (realizations, sums): what each realization gets more.
Score = Callable[[Rows, Rows, Callable[[int], np.ndarray]], Iterator[tuple[np.ndarray, np.ndarray]]]


def values(measure: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Score:
    """Sums of kw * measure(x, partner's x) over the elements that both have; what is undefined adds nothing.

    measure may overwrite its second argument and must give 0 for an infinite one.
    """

    def score(mine: Rows, theirs: Rows, of: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = np.diff(theirs.x_at)
        z = np.full((len(size), int(size.max(initial=0))), np.inf)
        inside = np.arange(z.shape[1]) < size[:, None]
        z[inside] = theirs.x
        odd = not np.isfinite(theirs.x).all()
        for a in range(len(mine)):
            w = slice(mine.kw_at[a], mine.kw_at[a] + min(z.shape[1], mine.kw_at[a + 1] - mine.kw_at[a]))
            kw, x = mine.kw[w], mine.x[mine.x_at[a] : mine.x_at[a] + w.stop - w.start]
            some = np.flatnonzero(kw)
            row = of(mine.i[a])
            met = np.flatnonzero(row >= 0)
            if len(some):
                met = met[size[row[met]] > some[0]]
            if not len(some) or not len(met):
                continue
            row, every = row[met], len(size) <= len(met)
            rows = np.arange(len(size)) if every else row
            out, step = np.empty(len(rows)), max(1, CELLS // z.shape[1])
            for k in range(0, len(rows), step):
                own = rows[k : k + step]
                v = measure(x, z.take(own, axis=0)[:, : len(kw)])
                if odd or not np.isfinite(x).all():
                    v[~inside[own, : len(kw)] | np.isnan(v)] = 0
                out[k : k + step] = v @ kw
            yield met, out[row] if every else out

    return score


def synchrony(transform: Callable[[np.ndarray], np.ndarray], coherency: bool) -> Score:
    """Sums of kw * phase synchrony (or imaginary coherency) of the transformed signal and the partner's, of equal lengths."""

    def score(mine: Rows, theirs: Rows, of: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for n in np.unique(np.diff(mine.x_at)):
            a, b = (np.flatnonzero(np.diff(rows.x_at) == n) for rows in (mine, theirs))
            if not n or not len(b):
                continue
            place = np.full(len(theirs), -1)
            place[b] = np.arange(len(b))
            zb = transform(theirs.x[theirs.x_at[b][:, None] + np.arange(n)])
            eb = (np.abs(zb) ** 2).sum(1)
            zb = np.conj(zb if coherency else phase.unit(zb))
            for k in range(0, len(a), PRODUCT):
                own = a[k : k + PRODUCT]
                za = transform(mine.x[mine.x_at[own][:, None] + np.arange(n)])
                ea = (np.abs(za) ** 2).sum(1)
                za = za if coherency else phase.unit(za)
                rows = [of(mine.i[j]) for j in own]
                every = len(b) <= 8 * len(rows[0])
                product = zb @ za.T if every else None
                for j, row in enumerate(rows):
                    met = np.flatnonzero(row >= 0)
                    at = place[row[met]]
                    met, at = met[at >= 0], at[at >= 0]
                    s = product[at, j] if every else zb[at] @ za[j]
                    v = phase._coherency(s.imag, ea[j], eb[at]) if coherency else np.abs(s) / za.shape[1]
                    yield met, mine.kw[mine.kw_at[own[j]]] * v

    return score


def summed(mine: DataFrame, theirs: DataFrame, n: int, chosen: list[list[int]], seed: int, scores: list[Score], places: int = PLACES, segment: int = SEGMENT) -> DataFrame:
    """f, r, e: for each family and realization the sum over all of mine; realizations in which nothing meets have no row.

    mine: f, i (place from 0 to n - 1), t, kw, x; theirs: f, i, t, x.  Rows meet that have the same f and t, if the family's realization
    sends the place of mine to that of theirs; of an f, i and t there is one row.  chosen: the families' candidates in `derange`.
    """
    spark = mine.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = min(places, max(FEW, -(-n * len(chosen) // partitions)))
    ranges = max(1, -(-n // size))
    columns = ["f", "part", "t", "side", "i", "kw", "x"]
    mine = mine.withColumns({"part": F.floor(F.col("i") / size).cast("long"), "side": F.lit(0)}).select(columns)
    theirs = theirs.withColumns({"part": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranges - 1).cast("long"))), "side": F.lit(1), "kw": F.lit(None).cast("array<double>")}).select(columns)
    wide = {c: F.col(c).cast("array<double>") for c in ("kw", "x")} | {"t": F.col("t").cast("long"), "f": F.col("f").cast("int")}
    rows = mine.withColumns(wide).unionByName(theirs.withColumns(wide)).where("x IS NOT NULL")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        task, t, own, other, held, ready = None, None, [], [], 0, None
        images = total = met = None

        def meet():
            nonlocal other, held, ready, images
            if own and other:
                f, part = task
                if images is None:
                    images = derange.images(seed, np.array(chosen[f]), np.arange(part * size, min(n, (part + 1) * size)), n)
                ready = ready or Rows(own)
                theirs = Rows(other)
                first = int(theirs.i[0])
                where = np.full(int(theirs.i[-1]) - first + 1, -1)
                where[theirs.i - first] = np.arange(len(theirs))

                def of(i: int) -> np.ndarray:
                    to = images[i - part * size].astype(np.int64) - first
                    inside = (to >= 0) & (to < len(where))
                    return np.where(inside, where[np.where(inside, to, 0)], -1)

                for r, e in scores[f](ready, theirs, of):
                    total[r] += e
                    met[r] = True
            other, held = [], 0

        def sums():
            r = np.flatnonzero(met)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(r), task[0], np.int32)), pa.array(r), pa.array(total[r])], names=["f", "r", "e"])

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("f", "part", "t", "side")])
            cut = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))[: key.shape[1]])
            for a, b in zip(cut, np.append(cut[1:], key.shape[1]), strict=True):
                f, part, now, side = (int(x) for x in key[:, a])
                if (f, part) != task or now != t:
                    meet()
                    own, ready = [], None
                if (f, part) != task:
                    if task is not None:
                        yield sums()
                    task, images, total, met = (f, part), None, np.zeros(len(chosen[f])), np.zeros(len(chosen[f]), bool)
                t = now
                if not side:
                    own.append(batch.slice(a, b - a))
                    continue
                for k in range(a, b, 256):  # so that a segment keeps to its bytes
                    other.append(batch.slice(k, min(256, b - k)))
                    held += 8 * int(_sizes(other[-1].column("x")).sum())
                    if held > segment:
                        meet()
        if task is not None:
            meet()
            yield sums()

    order = ["f", "part", "t", "side", "i"]
    spread = rows.repartition(max(partitions, len(chosen) * ranges), "f", "part").sortWithinPartitions(*order)
    return spread.mapInArrow(run, "f int, r long, e double").groupBy("f", "r").agg(F.sum("e").alias("e"))
