"""Every SQL-expressible query of the inference engine equals DuckDB's rows."""

import compare
import numpy as np
import pytest

from synchro.operators import filters, phase
from synchro.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, sf_dir, con, name):
    assert compare.same(registry.queries()[name](spark, sf_dir), con, registry.oracle_sql()[name]) == ""


def test_entry_module_imports():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _gain(hz, low=4.0, high=8.0, rate=64.0):
    b, a = filters.butterworth(4, rate, low, high)
    z = np.exp(2j * np.pi * hz / rate)
    return abs(np.prod([np.polyval(p, z) / np.polyval(q, z) for p, q in zip(b, a)]))


def test_butterworth_response():
    assert _gain(4.0) == pytest.approx(2**-0.5, abs=1e-6) and _gain(8.0) == pytest.approx(2**-0.5, abs=1e-6)
    assert _gain(0.0) < 1e-9 and _gain(1.0) < 0.01 and _gain(20.0) < 0.01


def test_bandpass_is_linear_and_keeps_nulls(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=64)
    df = spark.createDataFrame([(0, x.tolist()), (1, (2 * x).tolist()), (2, []), (3, None)], "k long, x array<double>")
    got = {r.k: r.filtered for r in filters.bandpass(df, "k", "x", 64.0, 4.0, 8.0).collect()}
    assert np.allclose(np.array(got[1]), 2 * np.array(got[0])) and got[2] == [] and got[3] is None


def _by_sample(x, b, a):
    for bk, ak in zip(b, a):
        s1, s2 = np.linalg.solve(np.array([[1 + ak[1], -1], [ak[2], 1]]), np.array([bk[1] - ak[1] * bk[0], bk[2] - ak[2] * bk[0]]))[:, None] * x[:, 0]
        out = np.empty_like(x)
        for i in range(x.shape[1]):
            out[:, i] = y = bk[0] * x[:, i] + s1
            s1, s2 = bk[1] * x[:, i] - ak[1] * y + s2, bk[2] * x[:, i] - ak[2] * y
        x = out
    return x


@pytest.mark.parametrize("n", [1, 5, 63, 64, 65, 200, 2_700])
@pytest.mark.parametrize("rate, low, high", [(300.0, 4.0, 7.0), (64.0, 8.0, 13.0), (300.0, 13.0, 30.0)])
def test_filtering_by_steps_equals_sample_by_sample(n, rate, low, high):
    b, a = filters.butterworth(4, rate, low, high)
    x = np.random.default_rng(n).normal(size=(7, n)) + 3
    assert np.allclose(filters.filtered(x, b, a), _by_sample(x, b, a), atol=1e-9)


def test_long_signals_pass_in_parts(spark, monkeypatch):
    """Rows of many samples are transformed a bounded number at a time, with the same results."""
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=300).tolist(), rng.normal(size=300).tolist()) for k in range(60)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"a": [r[1] for r in rows], "b": [r[2] for r in rows]})
    monkeypatch.setattr(phase, "BATCH_BYTES", 16 * 300 * 7)
    cut = list(phase.parts(batch, "a", "b"))
    assert [p.num_rows for p in cut] == [7] * 8 + [4]
    whole = [m for p in cut for _, m in phase.by_length(p.column("a"))]
    assert np.concatenate(whole).tolist() == [r[1] for r in rows]


def test_coherency_of_the_chain_keeps_amplitudes(spark):
    """A band signal ten times as loud has the same phases, and coherency is that of amplitudes."""
    t = np.arange(1_500) / 300
    rng = np.random.default_rng(4)
    a = np.sin(2 * np.pi * 6 * t) * (1 + 0.5 * np.sin(2 * np.pi * 0.5 * t)) + 0.1 * rng.normal(size=1_500)
    z = np.sin(2 * np.pi * 6 * t + 1.0) + 0.1 * rng.normal(size=1_500)
    chain = {"rate": 300.0, "band": (4.0, 7.0), "anchor": 300, "window": (0.0, 4.0)}
    df = spark.createDataFrame([(0, a.tolist(), z.tolist()), (1, (10 * a).tolist(), z.tolist())], "k long, a array<double>, z array<double>")
    got = {r.k: r for r in phase.pairs(df, ["k"], "a", "z", chain=chain).collect()}
    u, v = phase.band_analytic(np.stack([a, z]), **chain)
    cross = np.vdot(v, u)
    want = abs(cross.imag) / np.sqrt((abs(u) ** 2).sum() * (abs(v) ** 2).sum())
    assert got[0].imcoh == pytest.approx(want) and got[1].imcoh == pytest.approx(want) and got[0].plv == pytest.approx(got[1].plv)
    assert got[0].plv == pytest.approx(abs((u / abs(u) * np.conj(v / abs(v))).mean())) and got[0].imcoh == pytest.approx(np.sin(1.0), abs=0.08)
