"""The nulls of the event stream in the form for Spark: blocks are scored once, and draws pick among the sums.

`inference` has the same nulls as SQL over draws and trials, their oracle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap, derange, draws, gram, partners
from ..operators.quantiles import quantiles
from ..operators.ranks import numbered
from ..sources.scratch import saved
from . import dialect, inference

NAMES = inference.NAMES
_COLUMNS = ("y", "kw", "v0", "v1", "v2")


def blocks(spark: SparkSession, sf_dir: str, informative: bool = True) -> DataFrame:
    """g, b, and arrays over the block's trials in order: y, kw, v0, v1, v2."""
    each = "SELECT g, b, sort_array(collect_list(struct(t, y, kw, v0, v1, v2))) AS s FROM tw" + (" WHERE n1 > 0 AND n0 > 0" if informative else "") + " GROUP BY g, b"
    arrays = ", ".join(f"transform(s, x -> CAST(x.{c} AS DOUBLE)) AS {c}" for c in _COLUMNS)
    rows = dialect.run(spark, sf_dir, f"WITH{inference.BASE} SELECT g, b, {arrays} FROM ({each})")
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "g", "b")  # a number: draws are work, whatever the bytes


def matrices(batch, columns: tuple[str, ...], by: str = "y") -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """(rows, matrices by column) for each length of the arrays."""
    size = np.diff(batch.column(by).offsets.to_numpy())
    parts = {c: (batch.column(c).values.to_numpy(zero_copy_only=False), batch.column(c).offsets.to_numpy()) for c in columns}
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        yield rows, {c: flat[first[:-1][rows][:, None] + np.arange(n)] for c, (flat, first) in parts.items()}


def unit_value(measure: str, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.abs(a - z)) if measure == "closeness" else (np.minimum(a, z) + 1) / (np.maximum(a, z) + 1)


def _values(mine: dict[str, np.ndarray], other: dict[str, np.ndarray]) -> np.ndarray:
    """The six units of each trial, in the last axis."""
    of = {d: (mine[a], other[z]) for d, (a, z) in inference.PAIRS.items()}
    return np.stack([unit_value(m, *of[d]) for d, m in inference.UNITS], axis=-1)


def _keys(batch, rows: np.ndarray) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False)[rows].astype(np.int64) for c in ("g", "b")]


def by_positives(keys: list[np.ndarray], y: np.ndarray, x: np.ndarray) -> Iterator[draws.Scored]:
    """Label allocations of blocks of one size, by the number of positives."""
    ones = y.sum(1).astype(int)
    for n1 in np.unique(ones):
        k = np.flatnonzero(ones == n1)
        yield draws.allocations([key[k] for key in keys], y.shape[1], int(n1), x[k])


def _label_score(batch) -> Iterator[draws.Scored]:
    for rows, m in matrices(batch, _COLUMNS):
        yield from by_positives(_keys(batch, rows), m["y"], _values(m, m))


def _time_score(batch) -> Iterator[draws.Scored]:
    for rows, m in matrices(batch, _COLUMNS):
        n = m["y"].shape[1]
        if n >= 4:
            shifted = [_values(m, {c: np.roll(m[c], -lag, axis=1) for c in ("v0", "v1", "v2")}) for lag in range(2, n - 1)]
            yield draws.choices(_keys(batch, rows), np.stack([(m["kw"][:, :, None] * x).sum(1) for x in shifted], axis=1))


def dyad_sums(kw: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Trials x three picks x units: what each trial adds if it takes that pair; units are two measures of three pairs."""
    three = kw[:, None, None] * x.reshape(len(x), 2, 3)
    return np.repeat(three.transpose(0, 2, 1), 3, axis=2)


def _dyad_score(batch) -> Iterator[draws.Scored]:
    for rows, m in matrices(batch, _COLUMNS):
        n = m["y"].shape[1]
        g, b = _keys(batch, rows)
        t = (b[:, None] * 10 + np.arange(n)).ravel()
        yield draws.choices([np.repeat(g, n), t], dyad_sums(m["kw"].ravel(), _values(m, m).reshape(-1, len(NAMES))))


_SCORES = {"label": (_label_score, inference.LABELS), "time": (_time_score, inference.SHIFTS), "dyad": (_dyad_score, inference.DYADS)}


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g of the groups with a complete trial, and its place i."""
    return saved(numbered(dialect.run(spark, sf_dir, f"WITH{inference.BASE} SELECT DISTINCT g FROM tt"), [F.col("g")]), "groups")


#: Trials of a group that one row has.
SLAB = 256


def _measure(measure: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The unit's value, made in the second array's place."""

    def closeness(a: np.ndarray, z: np.ndarray) -> np.ndarray:
        z -= a
        np.abs(z, out=z)
        z += 1
        return np.divide(1, z, out=z)

    def ratio(a: np.ndarray, z: np.ndarray) -> np.ndarray:
        high = np.maximum(a, z)
        high += 1
        np.minimum(a, z, out=z)
        z += 1
        z /= high
        return z

    return closeness if measure == "closeness" else ratio


def _partner_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = ", ".join(f"transform(s, x -> CAST(x.{c} AS DOUBLE)) AS {c}" for c in ("kw", "v0", "v1", "v2"))
    each = f"SELECT g, CAST(floor(t / {SLAB}) AS BIGINT) AS t, sort_array(collect_list(struct(t, kw, v0, v1, v2))) AS s FROM tw GROUP BY g, CAST(floor(t / {SLAB}) AS BIGINT)"
    every = saved(dialect.run(spark, sf_dir, f"WITH{inference.BASE} SELECT g, t, {arrays} FROM ({each})"), "slabs")  # the events are read once
    places = saved(numbered(every.select("g").distinct(), [F.col("g")]), "groups")
    n, rows = places.count(), every.join(places, "g")
    chosen = derange.chosen(places, n, inference.PARTNERS, inference.SEEDS["partner"], len(NAMES)) if n else [[]] * len(NAMES)
    of = [inference.PAIRS[d] for d, _ in inference.UNITS]
    mine, theirs = (F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(pair[k]).alias("x")) for f, pair in enumerate(of)))).alias("q") for k in (0, 1))
    mine = rows.where("exists(kw, x -> x <> 0)").select("i", "t", "kw", mine).select("q.f", "i", "t", "kw", "q.x")  # trials of blocks of both classes
    theirs = rows.select("i", "t", theirs).select("q.f", "i", "t", "q.x")
    got = partners.summed(mine, theirs, n, chosen, inference.SEEDS["partner"], [partners.values(_measure(m)) for _, m in inference.UNITS])
    return got.select("r", F.expr("CASE f " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END").alias("u"), "e")


def null(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """r, u, e: the realizations of a null, of every unit."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if kind == "partner":
            sums = _partner_sums(spark, sf_dir)
        else:
            score, times = _SCORES[kind]
            sums = draws.picked(blocks(spark, sf_dir), score, NAMES, times, inference.SEEDS[kind], kind == "label")
        total = dialect.run(spark, sf_dir, f"WITH{inference.BASE} SELECT w_all FROM tot")
        return sums.crossJoin(F.broadcast(total)).select("r", "u", (F.col("e") / F.col("w_all")).alias("e"))  # total has one row

    return run


def _coefficient_score(batch) -> Iterator[draws.Scored]:
    """What a realization's coefficients add up to: all of them, the positive ones, and how many there are."""
    for rows, m in matrices(batch, ("y",)):
        n, keys, ones = m["y"].shape[1], _keys(batch, rows), m["y"].sum(1).astype(int)
        for n1 in np.unique(ones):
            k = np.flatnonzero(ones == n1)
            coef = draws.unranked(np.arange(draws.comb(n, int(n1))), n, int(n1)) - n1 / n
            sums = np.stack([coef.sum(1), np.maximum(coef, 0).sum(1), np.full(len(coef), n)], axis=1)
            yield draws.choices([key[k] for key in keys], np.broadcast_to(sums, (len(k), *sums.shape)))


def _coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = draws.picked(blocks(spark, sf_dir), _coefficient_score, ["total", "positive", "n"], inference.LABELS, inference.SEEDS["label"], True)
    got = got.groupBy("r").agg(*(F.max(F.when(F.col("u") == u, F.col("e"))).alias(u) for u in ("total", "positive", "n")))
    w = dialect.run(spark, sf_dir, f"WITH{inference.BASE} SELECT w_all FROM tot")
    share = lambda c: F.round(F.col(c) / F.col("w_all"), 6).alias(c)
    return got.crossJoin(F.broadcast(w)).select(F.col("r").alias("realization"), F.col("n").cast("long").alias("n"), share("total"), share("positive"))


def _derangements(spark: SparkSession, sf_dir: str) -> DataFrame:
    de = derange.derangements(groups(spark, sf_dir), inference.PARTNERS, inference.SEEDS["partner"])
    return de.select(F.col("r").alias("realization"), "g", F.col("h").alias("partner"))


def resamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, u, e: bootstrap resamples of the groups."""
    wide = ", ".join([f"max(CASE WHEN u = '{u}' THEN effect * w END) AS a{i}, max(CASE WHEN u = '{u}' THEN w END) AS b{i}" for i, u in enumerate(NAMES)])
    rows = saved(dialect.run(spark, sf_dir, f"WITH{inference.BASE} SELECT g, {wide} FROM ge GROUP BY g"), "effects")
    xs = F.array(*(F.coalesce(F.col(f"{c}{i}"), F.lit(0.0)) for c in "ab" for i in range(len(NAMES))))
    rows = saved(numbered(rows.select("g", xs.alias("xs")), [F.col("g")]), "effects")
    return bootstrap.resampled(rows.select("i", "xs"), rows.count(), NAMES, inference.RESAMPLES, inference.BOOT_SEED)


def _gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest, middle and largest correlation between the units' label nulls."""
    rows = null("label")(spark, sf_dir).groupBy("u").agg(F.sort_array(F.collect_list(F.struct("r", "e"))).alias("s"))  # LABELS realizations a unit
    rows = numbered(rows.select("u", F.transform("s", lambda x: x["e"]).alias("e")), [F.col("u")])
    got = gram.summary(rows.select("i", "e"), block=4)
    return got.select("n_units", "n_pairs", *(F.round(c, 6).alias(c) for c in ("low", "median", "high")))


def _cube_descriptives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of every unit's values and of its groups' spreads, without a group in one task."""
    base = f"WITH{inference.BASE}"
    sums = dialect.run(spark, sf_dir, f"{base} SELECT u AS unit, count(*) AS n, round(min(x), 6) AS low, round(avg(x), 6) AS mean, round(max(x), 6) AS high, round(stddev_pop(x), 6) AS sd, round(avg(CASE WHEN x >= 0.95 THEN 1e0 ELSE 0e0 END), 6) AS near_one FROM ux GROUP BY u")
    values = dialect.run(spark, sf_dir, f"{base} SELECT u AS unit, x FROM ux")
    spread = saved(dialect.run(spark, sf_dir, f"{base} SELECT u AS unit, g, stddev_pop(x) AS sd FROM ux GROUP BY u, g"), "spreads")
    of_x = quantiles(values, ["unit"], "x", {"p01": 0.01, "median": 0.5, "p99": 0.99})
    of_sd = quantiles(spread, ["unit"], "sd", {"median_group_sd": 0.5}).join(spread.groupBy("unit").agg(F.min("sd").alias("min_group_sd")), "unit")
    six = lambda df: df.select("unit", *(F.round(c, 6).alias(c) for c in df.columns[1:]))
    return sums.join(six(of_x), "unit").join(six(of_sd), "unit")


def _rank_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of the groups' ranks between units; ranks are places in ranges."""
    rows = saved(dialect.run(spark, sf_dir, f"WITH{inference.BASE}{inference.LOTO} SELECT u, g, round(effect, 9) AS effect FROM lo"), "ranked")
    rows = numbered(rows, [F.col("effect"), F.col("g")], "k", ["u"]).select("u", "g", F.col("k").cast("double").alias("k"))
    a, b = rows.select(F.col("u").alias("unit_a"), "g", F.col("k").alias("ka")), rows.select(F.col("u").alias("unit_b"), "g", F.col("k").alias("kb"))
    return a.join(b, "g").where("unit_a < unit_b").groupBy("unit_a", "unit_b").agg(F.round(F.corr("ka", "kb"), 6).alias("rank_correlation"))


def _unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = f"WITH{inference.BASE}{inference.UNWEIGHTED}"
    pops = saved(dialect.run(spark, sf_dir, steps + " SELECT u, pop, n, m FROM up"), "units")
    rows = numbered(dialect.run(spark, sf_dir, steps + " SELECT g, pop, n, effect AS x FROM ge JOIN up ON up.u = ge.u"), [F.col("g")], "i", ["pop"])
    rows = bootstrap.means(rows, inference.RESAMPLES, inference.UNWEIGHTED_SEED).groupBy("pop").agg(*(F.round(F.percentile("m", q), 6).alias(c) for c, q in (("low", 0.025), ("high", 0.975))))
    return pops.join(rows, "pop").select(F.col("u").alias("unit"), F.lit(inference.RESAMPLES).cast("long").alias("draws"), F.round("m", 6).alias("mean"), "low", "high")


def _with_null(kind: str, text: str) -> Callable:
    return lambda spark, sf_dir: dialect.run(spark, sf_dir, text, nu_rows=null(kind)(spark, sf_dir))


def _with_resamples(text: str) -> Callable:
    return lambda spark, sf_dir: dialect.run(spark, sf_dir, text, bs_rows=resamples(spark, sf_dir))


def frames() -> dict[str, Callable]:
    given = {kind: ", nu AS (SELECT r, u, e FROM {nu_rows})" for kind in inference.STEPS}
    texts, kinds = inference.null_texts(given), {name: x[0] for name, x in inference._queries().items() if isinstance(x, tuple) and x[0] in given}
    return {
        **{name: _with_null(kinds[name], text) for name, text in texts.items()},
        **{name: _with_resamples(text) for name, text in inference.boot_texts(", bs AS (SELECT r, u, e FROM {bs_rows})").items()},
        "label_perm_coefficients": _coefficients, "derangements": _derangements, "null_gram": _gram, "cube_descriptives": _cube_descriptives, "rank_stability": _rank_stability, "unweighted_bootstrap": _unweighted,
    }


def oracles() -> dict[str, str]:
    base = "WITH" + inference.BASE
    return {name: dialect.duckdb_text(text) for name, text in {
        **inference.null_texts(inference.STEPS),
        **inference.boot_texts(inference.BOOT_STEPS),
        "label_perm_coefficients": base + inference.LABEL_STEPS + " SELECT r AS realization, count(*) AS n, round(sum(c) / sum(wn), 6) AS total, round(sum(CASE WHEN c > 0 THEN c ELSE 0 END) / sum(wn), 6) AS positive FROM pk GROUP BY r",
        "derangements": base + ", " + derange.derangements_sql("tt", inference.PARTNERS, inference.SEEDS["partner"]) + " SELECT r AS realization, g, h AS partner FROM de",
        "unweighted_bootstrap": base + inference.UNWEIGHTED + ", " + draws.stream_sql("ui", inference.UNWEIGHTED_SEED, ["pop", "i"], ["n"], inference.RESAMPLES)
        + ", bm AS (SELECT hs.r, hs.pop, avg(ui.x) AS m FROM hs JOIN ui ON ui.pop = hs.pop AND ui.i = h % hs.n GROUP BY hs.r, hs.pop) SELECT u AS unit, count(*) AS draws, round(max(up.m), 6) AS mean, round(PCT(bm.m, 0.025), 6) AS low, round(PCT(bm.m, 0.975), 6) AS high FROM bm JOIN up ON up.pop = bm.pop GROUP BY u",
        "null_gram": base + inference.LABEL_STEPS + ", pr AS (SELECT corr(a.e, b.e) AS x FROM nu a JOIN nu b ON a.r = b.r AND a.u < b.u GROUP BY a.u, b.u) SELECT CAST(6 AS BIGINT) AS n_units, count(*) AS n_pairs, round(min(x), 6) AS low, round(PCT(x, 0.5), 6) AS median, round(max(x), 6) AS high FROM pr",
    }.items()}
