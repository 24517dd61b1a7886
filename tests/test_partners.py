"""Sums over surrogate partners against loops, and that neither draws nor pairs of groups are written."""

import numpy as np
import pytest
from synchro.operators import derange, partners, phase
from synchro.plans import connectivity, nulls, registry

ROWS = "f int, i long, t long, kw array<double>, x array<double>"


def _expected(mine, theirs, chosen, n, seed, value):
    other, out = {(f, i, t): x for f, i, t, _, x in theirs if x is not None}, {}
    for f, own in enumerate(chosen):
        to = derange.permuted(seed, np.array(own), np.arange(n), n)
        for r in range(len(own)):
            for g, i, t, kw, x in mine:
                z = other.get((f, int(to[r, i]), t))
                if g == f and x is not None and z is not None and (e := value(f, kw, x, z)) is not None:
                    out[f, r] = out.get((f, r), 0.0) + e
    return out


def _got(spark, mine, theirs, n, chosen, seed, scores):
    rows = [spark.createDataFrame(x, ROWS).repartition(3) for x in (mine, theirs)]
    return {(x.f, x.r): x.e for x in partners.summed(rows[0], rows[1].drop("kw"), n, chosen, seed, scores, places=7, segment=600).collect()}


def test_values_of_arrays_of_unlike_lengths(spark):
    rng, n, seed = np.random.default_rng(3), 23, 5
    x = lambda i, t: [float(v) for v in rng.integers(0, 9, (i * 7 + t) % 6)]
    theirs = [(f, i, t, None, x(i, t)) for f in range(2) for i in range(n) for t in range(2) if (i + t) % 11]
    mine = [(f, i, t, [float(k % 2) * (i + 1) for k in range(len(v))], v) for f, i, t, _, v in theirs if i % 3]
    theirs[4] = (*theirs[4][:4], None)
    theirs[9] = (*theirs[9][:4], [None, 1.0, float("inf")])
    chosen = [[0, 3, 4, 8], [5, 6]]

    def value(f, kw, a, z):
        each = [(k, p, q) for k, p, q in zip(kw, a, z, strict=False) if k and p is not None]
        measure = nulls.unit_value("closeness" if f == 0 else "ratio", *np.array([[p, np.nan if q is None else q] for _, p, q in each]).T) if each else []
        return float(sum(k * v for (k, _, _), v in zip(each, measure, strict=True) if not np.isnan(v))) if each else None

    got = _got(spark, mine, theirs, n, chosen, seed, [partners.values(nulls._measure(m)) for m in ("closeness", "ratio")])
    want = _expected(mine, theirs, chosen, n, seed, value)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("n", [9, 60])
def test_signals_of_unlike_lengths(spark, n):
    """Few and many places for each realization: one matrix product, and partners by themselves."""
    rng, seed, chosen = np.random.default_rng(n), 2, [[1, 2, 7], [4, 6, 11]]
    theirs = [(f, i, t, None, None if i == 4 and t else [float(v) for v in rng.normal(0, 1, 8 if i % 5 else 12)]) for f in range(2) for i in range(n) for t in range(2) if i != 6 or t]
    theirs[3] = (*theirs[3][:4], [0.0] * len(theirs[3][4] or [0]))
    mine = [(f, i, t, [float(i - 3)], x) for f, i, t, _, x in theirs if i != 2]

    def value(f, kw, x, z):
        if len(x) != len(z):
            return None
        a, b = (phase.analytic(np.array([v])) for v in (x, z))
        if f == 0:
            return kw[0] * float(np.abs((phase.unit(a) * np.conj(phase.unit(b))).mean(1))[0])
        return kw[0] * float(phase._coherency((a * np.conj(b)).sum(1).imag, (np.abs(a) ** 2).sum(1), (np.abs(b) ** 2).sum(1))[0])

    got = _got(spark, mine, theirs, n, chosen, seed, [partners.synchrony(phase.analytic, c) for c in (False, True)])
    want = _expected(mine, theirs, chosen, n, seed, value)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("name", ["partner_null", "connectivity_partner_null_maxt", "band_partner_null_maxt"])
def test_draws_are_no_rows(spark, monkeypatch, name):
    """What is written grows with the groups, not with realizations or with pairs of groups (500 groups at sf0.1 had 3 million derangements)."""
    written = {}

    def counting(df, what, saved=nulls.saved):
        out = saved(df, what)
        written[what] = max(written.get(what, 0), out.count())
        return out

    for module in (nulls, connectivity):
        monkeypatch.setattr(module, "saved", counting)
    registry.queries()[name](spark, "/root/testdata/sf0.01").collect()
    assert written and max(written.values()) <= 500
