"""Published values of the statistics, and signal operators against plain loops."""

import itertools

import numpy as np
import pytest

from synchro.operators import behavior, filters, phase
from synchro.plans import inference, registry, signals

#: Positive and other trials of 11 groups in 4 blocks of 10, published with their weights.
BLOCKS = [
    (10, 0), (0, 10), (2, 8), (0, 10), (10, 0), (10, 0), (8, 2), (9, 1), (7, 3), (4, 6), (8, 2), (0, 10), (1, 9), (3, 7), (9, 1), (10, 0), (6, 4), (0, 10), (0, 10), (0, 10), (10, 0), (10, 0),
    (10, 0), (6, 4), (10, 0), (10, 0), (10, 0), (9, 1), (1, 9), (2, 8), (1, 9), (6, 4), (10, 0), (2, 8), (0, 10), (0, 10), (8, 2), (10, 0), (10, 0), (7, 3), (4, 6), (2, 8), (9, 1), (7, 3),
]
#: Weight and effect of each group for one unit, then the effect without it.
GROUPS = [
    (1.600000023841858, 0.10057714581489563, 0.06517045280728097), (2.5, 0.025417353957891464, 0.06957817751866911), (6.099999904632568, 0.0439206138253212, 0.0710281484741871),
    (3.9000000953674316, 0.03142393007874489, 0.07070757485244937), (2.4000000953674316, 0.005288833286613226, 0.07081458239032902), (2.4000000953674316, 0.06606674194335938, 0.06670565323249927),
    (0.8999999761581421, 0.09082532674074173, 0.0660775155990477), (5.800000190734863, 0.06778378784656525, 0.06646308101883974), (1.600000023841858, 0.2939055263996124, 0.0566490916533448),
    (3.700000047683716, 0.07886578887701035, 0.06534524711939955), (7.0, 0.07192579656839371, 0.06547347232803467),
]
FULL = 0.06666519492864609


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    """Events of the published labels: 11 groups of three, 40 trials."""
    path, rows = str(tmp_path_factory.mktemp("published")), []
    for g, t in itertools.product(range(11), range(40)):
        positive = t % 10 < BLOCKS[4 * g + t // 10][0]
        for p in range(3):
            rows.append((len(rows), 3 * g + p, t, "click" if positive or p == t % 3 else "view", float(p)))
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string, value double").write.parquet(f"{path}/events.parquet")
    return path


def test_published_block_weights(spark, published):
    rows = {(r.g, r.b): r for r in registry.queries()["block_balance"](spark, published).collect()}
    assert [(rows[i // 4, i % 4].ccc, rows[i // 4, i % 4].other) for i in range(44)] == BLOCKS
    assert sum(r.information_weight for r in rows.values()) == pytest.approx(37.9) and sum(r.informative for r in rows.values()) == 23
    weights = {r.g: r.block_information for r in registry.queries()["block_triad_ratio"](spark, published).collect()}
    assert [weights[g] for g in range(11)] == pytest.approx([w for w, _, _ in GROUPS], abs=1e-6)
    assert sum(r.triad_information for r in registry.queries()["block_triad_ratio"](spark, published).collect()) == pytest.approx(70.775)


def test_published_coefficients(spark, published):
    r = registry.queries()["coeff_algebra_checks"](spark, published).first()
    assert r.sums_to_zero and r.positive_is_one and r.negative_is_one and r.n == 230  # 23 blocks of 10 trials


def test_published_effects_without_a_group(spark):
    values = ", ".join(f"('u', {g}, {e!r}D, {w!r}D)" for g, (w, e, _) in enumerate(GROUPS))
    got = spark.sql(f"WITH ge AS (SELECT * FROM VALUES {values} AS v(u, g, effect, w))" + inference.LOTO + " SELECT g, full_effect, loto FROM lo").collect()
    assert {r.g: r.loto for r in got} == pytest.approx({g: x for g, (_, _, x) in enumerate(GROUPS)}, abs=1e-15)
    assert all(r.full_effect == pytest.approx(FULL, abs=5e-9) for r in got)  # published to 1.7e-9


def test_labels_of_choices(spark, tmp_path):
    choices = ["CCDC", "CDDC", "CCCD"]
    rows = [(4 * p + t, p, t, "click" if c == "C" else "view", 1.0) for p, own in enumerate(choices) for t, c in enumerate(own)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert [r.label for r in sorted(registry.queries()["labels_ccc"](spark, str(tmp_path)).collect(), key=lambda r: r.t)] == [1, 0, 0, 0]


# ------------------------------------------------------------------ behaviour


@pytest.mark.parametrize("raw, want", [("", None), (" ", None), (None, None), ("2.5", 2), ("3.5", 4), (" 7 ", 7), ("1e1", 10), ("trial 12 of 40", 12), ("none", None), ("-3", -3), ("4d", 4), ("NaN", None)])
def test_trial_numbers(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(behavior.trial_number(signals.F.col("x")).alias("t")).first().t == want


def test_choices(spark):
    said = {"c": "C", " Coop ": "C", "1.0": "C", "COOPERATION": "C", "uncooperative": "C", "d": "D", "2": "D", "0.0": "D", "defector": "D", "": None, None: None, "3": None}
    rows = spark.createDataFrame([(k,) for k in said], "x string")
    assert {r.x: r.c for r in rows.select("x", behavior.choice(signals.F.col("x")).alias("c")).collect()} == said


def test_choice_vectors_hold_their_keys(spark):
    rows = [(1, "1", "coop"), (1, "2", "D"), (1, "2.0", "defect"), (1, "x", "C"), (1, "3", "?"), (1, "3", "c")]
    run = lambda rows, n=3: behavior.choice_vectors(spark.createDataFrame(rows, "g int, trial string, raw string"), ["g"], "trial", "raw", n).collect()
    assert run(rows)[0].choices == ["C", "D", "C"]
    for bad in ([*rows, (1, "1", "D")], rows[:-1], [*rows, (1, "5", "C")]):
        with pytest.raises(Exception, match="conflicting|complete"):
            run(bad)


# ------------------------------------------------------------------ signals


def _filtered(x, b, a):
    """One section after the other, sample by sample, from the steady state of the first sample."""
    for bk, ak in zip(b, a):
        gain = sum(bk) / sum(ak)
        y_before, x_before = [gain * x[0]] * 2, [x[0]] * 2
        out = []
        for v in x:
            y = bk[0] * v + bk[1] * x_before[0] + bk[2] * x_before[1] - ak[1] * y_before[0] - ak[2] * y_before[1]
            x_before, y_before = [v, x_before[0]], [y, y_before[0]]
            out.append(y)
        x = out
    return x


def _chain(x, rate, band, anchor, window, pad_seconds):
    pad = max(1, min(round(pad_seconds * rate), len(x) - 2))
    x = [x[k] for k in range(pad, 0, -1)] + list(x) + [x[-2 - k] for k in range(pad)]
    b, a = filters.butterworth(4, rate, *band)
    x = _filtered(_filtered(x, b, a)[::-1], b, a)[::-1]
    n = len(x)
    f = [sum(v * np.exp(-2j * np.pi * k * i / n) for i, v in enumerate(x)) for k in range(n)]
    gain = [1 if k in (0, n / 2) else 2 if k < n / 2 else 0 for k in range(n)]
    z = [sum(g * v * np.exp(2j * np.pi * k * i / n) for k, (g, v) in enumerate(zip(gain, f))) / n for i in range(n)]
    z = z[pad:-pad][anchor + round(window[0] * rate) : anchor + round(window[1] * rate)]
    return [v / abs(v) for v in z]


def test_band_phase_against_loops(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=n).tolist()) for i, n in enumerate((48, 48, 64))] + [(3, None), (4, [])]
    df = spark.createDataFrame(rows, "k long, x array<double>")
    bands = {"low": (4.0, 8.0), "high": (8.0, 13.0)}
    got = {(r.k, r.band): r for r in phase.phase_tensor(df, ["k"], "x", 64.0, bands, 8, (0.0, 0.5), pad_seconds=0.25).collect()}
    assert len(got) == 10
    for (k, band), r in got.items():
        if k > 2:
            assert r.re is None and r.im is None
        else:
            assert np.array(r.re) + 1j * np.array(r.im) == pytest.approx(np.array(_chain(rows[k][1], 64.0, bands[band], 8, (0.0, 0.5), 0.25)), abs=1e-6)
    with pytest.raises(Exception, match="does not lie within"):
        phase.phase_tensor(df, ["k"], "x", 64.0, bands, 8, (0.0, 0.7)).collect()


def _sensor(spark, a, z, channels):
    df = spark.createDataFrame([(0, np.asarray(a).ravel().tolist(), np.asarray(z).ravel().tolist())], "k long, a array<double>, z array<double>")
    return np.array(phase.sensor_edges(df, ["k"], "a", "z", channels).first().edges).reshape(channels, channels)


def test_sensor_edges_of_nineteen_channels(spark):
    """Amplitude doesn't matter, equal phases give 1, and exchanging the participants transposes the matrix."""
    rng = np.random.default_rng(2)
    a, z = rng.normal(size=(19, 200)), rng.normal(size=(19, 200))
    m = _sensor(spark, a, z, 19)
    assert m.shape == (19, 19) and (m >= 0).all() and (m <= 1 + 1e-12).all()
    assert _sensor(spark, z, a, 19).T == pytest.approx(m, abs=1e-12)
    assert np.diag(_sensor(spark, a, 10 * a, 19)) == pytest.approx(np.ones(19), abs=1e-12)


def test_coherency_of_phasors(spark):
    """No lag gives 0 and a quarter of a cycle gives 1, whatever the amplitudes."""
    t = np.arange(600) / 300
    wave = np.cos(2 * np.pi * 10 * t)
    rows = [(0, wave.tolist(), (7 * wave).tolist()), (1, wave.tolist(), (0.2 * np.sin(2 * np.pi * 10 * t)).tolist()), (2, wave.tolist(), [0.0] * 600), (3, wave.tolist(), None), (4, wave.tolist(), wave[:10].tolist())]
    got = {r.k: r for r in phase.pairs(spark.createDataFrame(rows, "k long, a array<double>, z array<double>"), ["k"], "a", "z").collect()}
    assert got[0].imcoh == pytest.approx(0, abs=1e-9) and got[1].imcoh == pytest.approx(1, abs=1e-9) and got[2].imcoh == 0 and set(got) == {0, 1, 2}
    assert got[0].plv == pytest.approx(1) and got[1].plv == pytest.approx(1)


def test_lags_are_circular_shifts(spark):
    rng = np.random.default_rng(3)
    a, z = rng.normal(size=30), rng.normal(size=30)
    rows = [(lag, a.tolist(), np.roll(z, lag).tolist()) for lag in range(30)]
    df = spark.createDataFrame(rows, "k long, a array<double>, z array<double>")
    every = next(r for r in phase.pairs(df, ["k"], "a", "z", lags=True).collect() if r.k == 0)
    one = {r.k: r for r in phase.pairs(df, ["k"], "a", "z").collect()}
    assert every.plv == pytest.approx([one[k].plv for k in range(30)]) and every.imcoh == pytest.approx([one[k].imcoh for k in range(30)])
