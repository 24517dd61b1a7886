"""Draws of the nulls against plain Python."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from synchro.operators import bootstrap, derange, draws, gram
from synchro.plans import detection, inference, nulls, registry


def test_derangements_of_the_groups(spark, sf_dir):
    """A thousand permutations of the groups, none with a fixed point, all of the keyed bijections in order."""
    got = {}
    for x in registry.queries()["derangements"](spark, sf_dir).collect():
        got.setdefault(x.realization, {})[x.g] = x.partner
    groups = np.array(sorted(got[0]))
    n = len(groups)
    every = derange.permuted(inference.SEEDS["partner"], np.arange(4_000), np.arange(n), n)
    want = [dict(zip(groups.tolist(), groups[p].tolist(), strict=True)) for p in every if (p != np.arange(n)).all()][:1_000]
    assert len(want) == 1_000 and got == dict(enumerate(want))


@pytest.mark.parametrize("n", [3, 4, 5, 6])
def test_derangements_are_uniform(n):
    every = derange.permuted(5, np.arange(60_000), np.arange(n), n)
    assert (np.sort(every, axis=1) == np.arange(n)).all()
    every = every[(every != np.arange(n)).all(1)]
    _, found = np.unique(every, axis=0, return_counts=True)
    kinds = {3: 2, 4: 9, 5: 44, 6: 265}[n]
    even = len(every) / kinds
    assert len(found) == kinds and ((found - even) ** 2 / even).sum() < kinds - 1 + 4 * (2 * (kinds - 1)) ** 0.5


def test_too_few_derangements(spark):
    groups = spark.createDataFrame([(7, 0)], "g long, i long")
    with pytest.raises(ValueError, match="0 derangements"):
        derange.derangements(groups, 3, 1)
    assert derange.derangements(groups.limit(0), 3, 1).count() == 0
    own = derange.derangements(spark.range(6).select((F.col("id") * 5).alias("g"), F.col("id").alias("i")), 40, 1, families=3).toPandas()
    assert len(own) == 3 * 40 * 6 and (own.g != own.h).all() and own.groupby(["f", "r"]).h.nunique().eq(6).all()
    assert own[own.f == 0].h.tolist() != own[own.f == 1].h.tolist()


def test_allocations_are_all_and_even():
    for n, n1 in ((4, 2), (10, 3), (10, 9), (7, 0)):
        every = draws.unranked(np.arange(draws.comb(n, n1)), n, n1)
        assert len({tuple(x) for x in every}) == draws.comb(n, n1) and (every.sum(1) == n1).all()
        assert [tuple(x) for x in every] == sorted(map(tuple, every), reverse=True)
    picks = np.concatenate([draws.stream(3, 500, [np.arange(40), np.full(40, b)]).ravel() % 15 for b in range(3)])
    assert abs(np.bincount(picks, minlength=15) - 4_000).max() < 260


def _score(batch):
    y, x = (np.array(batch.column(c).to_pylist(), float) for c in ("y", "x"))
    key = batch.column("k").to_numpy()
    for n1 in np.unique(y.sum(1)).astype(int):
        rows = np.flatnonzero(y.sum(1) == n1)
        yield draws.allocations([key[rows]], y.shape[1], int(n1), x[rows].reshape(len(rows), y.shape[1], 2))


@pytest.mark.parametrize("n, shared", [(6, True), (6, False), (20, True), (20, False)])
def test_picked_sums_equal_a_loop(spark, n, shared):
    """Blocks with few allocations pick from a table, those with many are unranked draw by draw."""
    rng = np.random.default_rng(n)
    rows = [(k, rng.permutation([1.0] * (n // 2 + k % 2) + [0.0] * (n - n // 2 - k % 2)).tolist(), rng.normal(size=2 * n).tolist()) for k in range(9)]
    got = {(r.r, r.u): r.e for r in draws.picked(spark.createDataFrame(rows, "k long, y array<double>, x array<double>").repartition(3), _score, ["a", "b"], 50, 8, shared).collect()}
    want = dict.fromkeys(((r, u) for r in range(50) for u in "ab"), 0.0)
    for k, y, x in rows:
        n1 = int(sum(y))
        count = draws.comb(n, n1)
        for i, u in enumerate("ab"):
            unit = None if shared else i
            first, second = (draws.stream(s, 50, [np.array([k])], unit)[:, 0] for s in (8, 8 + 1_000_003))
            for r in range(50):
                index = first[r] % count if count <= draws.TABLE else (int(first[r]) * draws.PRIME + int(second[r])) % count
                bits = draws.unranked(np.array([index]), n, n1)[0]
                want[r, u] += sum((b - n1 / n) * x[2 * t + i] for t, b in enumerate(bits))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize("kind", ["time", "dyad", "partner"])
def test_units_draw_for_themselves(spark, tmp_path, kind):
    """Two units of the same values of noise have nulls that do not go together."""
    rng, rows = np.random.default_rng(11), []
    for g in range(30):
        for t in range(40):
            v = rng.uniform(0, 100, 3)
            for p in range(3):
                rows.append((len(rows), 3 * g + p, t, ["click", "view"][int(rng.integers(2))] if p == 0 else "click", float(v[p])))
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    e = nulls.null(kind)(spark, str(tmp_path)).toPandas().pivot(index="r", columns="u", values="e")
    assert e.shape[1] == 6
    together = np.corrcoef(e["pair12|closeness"], e["pair12|ratio"])[0, 1]  # both grow with nearness, so shared draws would go together
    assert abs(together) < 5 / len(e) ** 0.5


def test_resample_counts_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "SLOTS", 64)
    whole = bootstrap.counts(4, 100, 7, 41, 0, 41)
    assert (whole.sum(1) == 41).all() and (np.concatenate([bootstrap.counts(4, 100, 7, 41, a, 10) for a in (0, 10, 20, 30)], axis=1) == whole[:, :40]).all()
    for r in range(7):
        to = [int(draws.stream(104 + r, 1, [np.array([slot])])[0, 0]) % 41 for slot in range(41)]
        assert np.bincount(to, minlength=41).tolist() == whole[r].tolist()
    rng = np.random.default_rng(2)
    xs = rng.normal(size=(41, 4))
    xs[:, 2:] = np.abs(xs[:, 2:])
    got = {(r.r, r.u): r.e for r in bootstrap.resampled(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)], "i long, xs array<double>").repartition(4), 41, ["a", "b"], 1_300, 4).collect()}
    every = bootstrap.counts(4, 0, 1_000, 41, 0, 41) @ xs
    assert len(got) == 2_600 and all(got[r, u] == pytest.approx(every[r, i] / every[r, i + 2]) for r in range(1_000) for i, u in enumerate("ab"))


def test_means_of_resamples_by_population(spark, monkeypatch):
    """Each population is resampled from its own rows, as a loop over slots does."""
    rng = np.random.default_rng(5)
    sizes = {0: 1, 3: 17, 4: 90}
    rows = [(p, i, n, float(rng.normal())) for p, n in sizes.items() for i in range(n)]
    got = {(r.pop, r.r): r.m for r in bootstrap.means(spark.createDataFrame(rows, "pop long, i long, n long, x double"), 1_200, 6).collect()}
    assert len(got) == 3 * 1_200
    for p, n in sizes.items():
        x = np.array([r[3] for r in rows if r[0] == p])
        h = draws.stream(6, 1_200, [np.full(n, p), np.arange(n)])[:1_000] % n
        assert np.allclose([got[p, r] for r in range(1_000)], x[h].mean(1))
        assert n == 1 or 0.8 < np.std([got[p, r] for r in range(1_200)]) / (x.std() / n**0.5) < 1.2


@pytest.mark.parametrize("units, block", [(23, 4), (40, 512), (2, 1), (1, 8)])
def test_gram_summary_equals_numpy(spark, units, block):
    rng = np.random.default_rng(units)
    e = rng.normal(size=(units, 60)) + rng.normal(size=60)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(e)] + [(units, [1.0] * 60)], "i long, e array<double>")
    got = gram.summary(df.repartition(3), block).first()
    r = np.corrcoef(e)[np.triu_indices(units, 1)] if units > 1 else np.zeros(0)
    assert (got.n_units, got.n_pairs) == (units, len(r))
    assert len(r) == 0 or (got.low, got.median, got.high) == pytest.approx((r.min(), np.median(r), r.max()), abs=1e-12)


@pytest.mark.parametrize("name", ["partner_null_maxt", "connectivity_partner_null_maxt"])
def test_partner_nulls_can_reject(spark, sf_dir, name):
    """p is a multiple of 1 / 1001, so a strong effect can fall below 0.05."""
    for x in registry.queries()[name](spark, sf_dir).collect():
        assert x.p_maxt * 1001 == pytest.approx(round(x.p_maxt * 1001), abs=1e-2)


def test_bootstrap_of_means_resamples(spark, sf_dir, tmp_path):
    """Intervals are those of independent draws of rows, also where the number of rows is a large prime."""
    rng, n = np.random.default_rng(3), 211
    score = rng.normal(25, 8, n).tolist()
    rows = [("A", "F", i, 0.0, x) for i, x in enumerate(score)] + [("N", "O", 7, 0.0, 25.0)]
    spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, l_suppkey long, l_discount double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {x.scenario: x for x in registry.queries()["bootstrap_mean_ci"](spark, str(tmp_path)).collect()}
    first = [np.array(score)[h % n].mean() for h in draws.stream(990000, 1_000, [np.zeros(n, int), np.arange(n)])]
    more = [np.array(score)[h % n].mean() for h in draws.stream(991000, 1_000, [np.zeros(n, int), np.arange(n)])]
    assert got["A"].draws == 2_000 and (got["A"].low, got["A"].high) == pytest.approx(tuple(np.percentile(first + more, [2.5, 97.5])), abs=1e-6)
    wide = 2 * 1.96 * np.std(score) / n**0.5
    assert 0.9 * wide < got["A"].high - got["A"].low < 1.1 * wide
    assert got["N"].low == got["N"].high == 25  # one row is all that a resample can hold


@pytest.mark.parametrize("alike, want", [((0, 1), (6, 2, 2, 2, 2, 2)), ((0, 1, 2), (6, 6, 6, 6, 6, 0)), ((), (6, 0, 0, 0, 0, 0))])
def test_funnel_passes_all_layers(spark, tmp_path, alike, want):
    """Participants who are alike in positive trials pass; where all three are, no pair stands out of its group."""
    rng, rows = np.random.default_rng(4), []
    for g in range(24):
        for t in range(40):
            y, common = t % 10 in (1, 2, 5, 8), rng.uniform(0, 100)
            for p in range(3):
                v = common if y and p in alike else rng.uniform(0, 100)
                rows.append((len(rows), 3 * g + p, t, "click" if y else "view", float(v)))
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    x = registry.queries()["attrition_funnel"](spark, str(tmp_path)).first()
    assert (x.searched, x.raw_pass, x.label_pass, x.time_pass, x.partner_pass, x.dyad_pass) == want


def test_valid_lags_follow_each_signal(spark, tmp_path):
    lengths = {0: 64, 1: 30, 2: 20, 31: 19, 32: 0}
    spark.createDataFrame([(i, [0.5] * n) for i, n in lengths.items()], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((x.g, x.t, x.p, x.lag) for x in registry.queries()["valid_lags"](spark, str(tmp_path)).collect())
    assert got == sorted((i // 30, i % 30 // 3, i % 3, lag) for i, n in lengths.items() for lag in range(10, n - 9))


def test_cluster_bootstrap_reaches_every_group(spark, tmp_path):
    """1009 groups, all of one effect but for sampling: the interval is that of independent draws of groups."""
    rng = np.random.default_rng(6)
    effect = rng.normal(0, 20, 1009)
    rows = []
    for g, e in enumerate(effect):
        for t in range(10):
            for p in range(3):
                v = 50.0 if p != 1 else 50.0 + (abs(e) if t < 5 else 1.0)
                rows.append((len(rows), 3 * g + p, t, "click" if t < 5 else "view", float(v)))
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    x = {x.unit: x for x in registry.queries()["cluster_bootstrap"](spark, str(tmp_path)).collect()}["pair12|closeness"]
    own = 1 / (1 + abs(effect)) - 0.5
    wide = 2 * 1.96 * own.std() / 1009**0.5
    assert x.draws == 10_000 and 0.93 * wide < x.high - x.low < 1.07 * wide and x.low < own.mean() < x.high


@pytest.mark.parametrize("name", ["connectivity_time_null_maxt", "connectivity_partner_null_maxt", "connectivity_dyad_null_maxt", "metric_agreement", "plv_all_lags", "phase_tensor", "cube_label_null_maxt"])
def test_an_empty_family_has_no_rows(spark, tmp_path, name):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert registry.queries()[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("held", [bootstrap.HELD, 7])
def test_slots_of_a_large_population_are_looked_at_once(spark, monkeypatch, held):
    """Means of resamples are those of the slots' hashes, whether a task holds all rows or a few; by default one task for each population."""
    rng, n, pops, k = np.random.default_rng(8), 70_000 if held > 7 else 40, 2, 5
    x = rng.normal(0, 1, (pops, n))
    rows = spark.createDataFrame([(p, i, n, float(x[p, i])) for p in range(pops) for i in range(n)], "pop long, i long, n long, x double")
    means = bootstrap.means(rows, k, 3) if held > 7 else bootstrap.means(rows, k, 3, held)
    got = {(r.pop, r.r): r.m for r in means.collect()}
    for p in range(pops):
        to = draws.stream(3, k, [np.full(n, p), np.arange(n)]) % n
        assert all(abs(got[p, r] - x[p, to[r]].mean()) < 1e-9 for r in range(k))


def test_items_are_read_twice_for_the_bounds_of_all_measures(spark, monkeypatch):
    """Once for the runs and once for the scores; a read for each measure, twice over, took 6 GB beyond its time."""
    reads, run = [], detection.dialect.run

    def counting(*a, **b):
        df = run(*a, **b)
        reads.append(sum("Relation [" in x and "l_suppkey" in x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        return df

    monkeypatch.setattr(detection.dialect, "run", counting)
    assert registry.queries()["cell_mean_bounds"](spark, "/root/testdata/sf0.001").count() > 0
    assert sum(reads) == 2
