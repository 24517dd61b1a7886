"""The matrix label null against a plain loop, and its edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from synchro.operators import label_null as nulls

SCHEMA = "part string, b long, t long, y int, xs array<double>"


def _rows(parts=3, blocks=4, units=5):
    rng = np.random.default_rng(5)
    y = {b: [int(v) for v in rng.permutation([1, 1, 0, 0, 0, 0])] for b in range(blocks)}
    y[blocks] = [1, 1, 1]  # a block of one class
    return [(f"p{p}", b, t, y[b][t], rng.normal(size=units).tolist()) for p in range(parts) for b in y for t in range(len(y[b]))]


def _plain(rows, draws, seed):
    parts, e = sorted({r[0] for r in rows}), {}
    for part in parts:
        total, weight = 0.0, 0.0
        for b in {r[1] for r in rows}:
            mine = sorted(r for r in rows if r[0] == part and r[1] == b)
            y, x = np.array([r[3] for r in mine]), np.array([r[4] for r in mine])
            n, n1 = len(y), y.sum()
            if 0 < n1 < n:
                keys = nulls.order_keys(seed, draws, b, np.array([r[2] for r in mine]))
                labels = [y] + [np.isin(np.arange(n), sorted(range(n), key=lambda i: (k[i], i))[:n1]).astype(int) for k in keys]
                w = n1 * (n - n1) / n
                total, weight = total + w * np.array([x[v == 1].mean(0) - x[v == 0].mean(0) for v in labels]), weight + w
        e[part] = total / weight
    z = {p: (v - v[1:].mean(0)) / v[1:].std(0, ddof=1) for p, v in e.items()}
    top = np.max([np.abs(v[1:]).max(1) for v in z.values()], 0)
    return {(p, k): (e[p][0, k], z[p][0, k], (1 + (top >= abs(z[p][0, k])).sum()) / (draws + 1)) for p in parts for k in range(e[p].shape[1])}


@pytest.mark.parametrize("salts", [1, 3])
def test_equals_a_plain_loop(spark, salts):
    rows = _rows()
    got = {(r.part, r.place): (r.effect, r.z, r.p_maxt) for r in nulls.label_null(spark.createDataFrame(rows, SCHEMA), 40, salts=salts).collect()}
    want = _plain(rows, 40, 3100)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-8) for k in want)


def test_undefined_units_and_empty_cubes(spark):
    rows = [(p, b, t, y, [None if b == 0 and t == 0 else x[0], 1.0, *x[2:]]) for p, b, t, y, x in _rows(parts=1)]
    got = {r.place: r for r in nulls.label_null(spark.createDataFrame(rows, SCHEMA), 20).collect()}
    for k in (0, 1):  # a missing value, and no spread
        assert got[k].z is None and got[k].p_unadjusted == got[k].p_maxt == 1
    assert got[0].effect is None and got[1].effect == pytest.approx(0) and got[2].z is not None
    assert nulls.label_null(spark.createDataFrame([], SCHEMA), 20).count() == 0
    one_class = spark.createDataFrame(_rows(), SCHEMA).withColumn("y", F.lit(1))
    assert nulls.label_null(one_class, 20).count() == 0


def test_orders_are_even():
    """Each of the 15 pairs of six trials comes first about equally often."""
    keys = np.concatenate([nulls.order_keys(1, 300, b, np.arange(6)) for b in range(100)])
    first = np.sort(np.argsort(keys, axis=1, kind="stable")[:, :2], axis=1)
    counts = np.bincount(first[:, 0] * 6 + first[:, 1], minlength=36)
    counts = counts[counts > 0]
    assert len(counts) == 15 and abs(counts - 2000).max() < 250
