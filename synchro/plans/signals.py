"""Signal and connectivity queries; a signal is an embedding, of trial t and participant p of group g.

Texts run in both engines, sample by sample; `frames` has the form for Spark of those that transform signals: arrays through
FFT in Arrow batches.  Their texts stay as the oracles, which share no code with them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, phase

N = 64
BASE = f"""
sg AS (
  SELECT CAST(floor(vec_id / 30) AS BIGINT) AS g, CAST(floor(vec_id % 30 / 3) AS BIGINT) AS t, vec_id % 3 AS p, i, x FROM UNROLL({{embeddings}}, vec_id, embedding) e
), hk AS (
  SELECT r AS n, CASE WHEN r % 2 = 1 THEN 2e0 / {N} * cos(pi() * r / {N}) / sin(pi() * r / {N}) ELSE 0e0 END AS h FROM SERIES({N}) s
), an AS (
  SELECT a.g, a.t, a.p, a.i, max(a.x) AS re, sum(b.x * h) AS im
  FROM sg a JOIN sg b ON a.g = b.g AND a.t = b.t AND a.p = b.p JOIN hk ON hk.n = (a.i - b.i + {N}) % {N} GROUP BY a.g, a.t, a.p, a.i
), ph AS (
  SELECT g, t, p, i, CASE WHEN re * re + im * im > 0 THEN re / sqrt(re * re + im * im) ELSE 0 END AS re, CASE WHEN re * re + im * im > 0 THEN im / sqrt(re * re + im * im) ELSE 0 END AS im FROM an
), cr AS (
  SELECT a.g, a.t, concat('pair', a.p + 1, b.p + 1) AS d, a.i, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im FROM ph a JOIN ph b ON a.g = b.g AND a.t = b.t AND a.i = b.i AND a.p < b.p
), plv AS (SELECT g, t, d, sqrt(avg(re) * avg(re) + avg(im) * avg(im)) AS plv FROM cr GROUP BY g, t, d
)"""



def lags_sql(n: int) -> str:
    """Sums by circular shift of signals of n samples in table SRC."""
    return f""", lg AS (
  SELECT a.g, a.t, concat('pair', a.p + 1, b.p + 1) AS d, (a.i - b.i + {n}) % {n} AS l, sum(a.re * b.re + a.im * b.im) / {n} AS re, sum(a.im * b.re - a.re * b.im) / {n} AS im
  FROM SRC a JOIN SRC b ON a.g = b.g AND a.t = b.t AND a.p < b.p GROUP BY a.g, a.t, a.p, b.p, (a.i - b.i + {n}) % {n}
)"""


LAGS = lags_sql(N)

COHERENCY = """, en AS (SELECT g, t, p, sum(re * re + im * im) AS e FROM an GROUP BY g, t, p
), cx AS (
  SELECT a.g, a.t, a.p, b.p AS q, sum(a.im * b.re - a.re * b.im) AS im FROM an a JOIN an b ON a.g = b.g AND a.t = b.t AND a.i = b.i AND a.p < b.p GROUP BY a.g, a.t, a.p, b.p
), ic AS (
  SELECT cx.g, cx.t, concat('pair', cx.p + 1, cx.q + 1) AS d, CASE WHEN x.e * y.e > 1e-20 THEN least(greatest(abs(im) / sqrt(x.e * y.e), 0e0), 1e0) ELSE 0e0 END AS icoh
  FROM cx JOIN en x ON x.g = cx.g AND x.t = cx.t AND x.p = cx.p JOIN en y ON y.g = cx.g AND y.t = cx.t AND y.p = cx.q
)"""

BAND = f""", bk AS (
  SELECT s.r AS n, sum(2e0 / {N} * cos(2 * pi() * k.r * s.r / {N})) AS kre, sum(2e0 / {N} * sin(2 * pi() * k.r * s.r / {N})) AS kim
  FROM SERIES({N}) s CROSS JOIN SERIES(9) k WHERE k.r >= 4 GROUP BY s.r
), bd AS (
  SELECT a.g, a.t, a.p, a.i, sum(b.x * kre) AS re, sum(b.x * kim) AS im
  FROM sg a JOIN sg b ON a.g = b.g AND a.t = b.t AND a.p = b.p JOIN bk ON bk.n = (a.i - b.i + {N}) % {N} GROUP BY a.g, a.t, a.p, a.i
)"""


def texts() -> dict[str, str]:
    q = {
        "reflect_pad": f"SELECT g, t, p, j.r - 8 AS place, round(x, 6) AS x FROM sg JOIN SERIES({N + 16}) j ON i = CASE WHEN j.r < 8 THEN 8 - j.r WHEN j.r < {N} + 8 THEN j.r - 8 ELSE 2 * {N} - 2 - (j.r - 8) END",
        "hilbert_phase": "SELECT g, t, p, i, round(re, 6) AS re, round(im, 6) AS im FROM ph",
        "band_analytic": (BAND, "SELECT g, t, p, i, round(re, 6) AS re, round(im, 6) AS im FROM bd"),
        "window_crop": "SELECT g, t, p, i - 16 AS place, round(x, 6) AS x FROM sg WHERE i >= 16 AND i < 48",
        "signal_rms": "SELECT g, t, p, round(sqrt(avg(x * x)), 6) AS rms, round(PCT(abs(x), 0.99), 6) AS p99 FROM sg GROUP BY g, t, p",
        "plv_pairs": "SELECT g, t, d AS dyad, round(plv, 6) AS plv FROM plv",
        "plv_channel_matrix": "SELECT a.g, a.t, a.p AS channel1, b.p AS channel2, round(sqrt(pow(avg(a.re * b.re + a.im * b.im), 2) + pow(avg(a.im * b.re - a.re * b.im), 2)), 6) AS plv FROM ph a JOIN ph b ON a.g = b.g AND a.t = b.t AND a.i = b.i GROUP BY a.g, a.t, a.p, b.p",
        "plv_all_lags": (LAGS.replace("SRC", "ph"), "SELECT g, t, d AS dyad, CAST(l AS BIGINT) AS lag, round(sqrt(re * re + im * im), 6) AS plv FROM lg"),
        "valid_lags": "SELECT g, t, p, CAST(i AS BIGINT) AS lag FROM (SELECT g, t, p, i, count(*) OVER (PARTITION BY g, t, p) AS n FROM sg) s WHERE least(i, n - i) >= 10",
        "imcoh_pairs": (COHERENCY, "SELECT g, t, d AS dyad, round(icoh, 6) AS imcoh FROM ic"),
        "imcoh_all_lags": (LAGS.replace("SRC", "an") + COHERENCY.replace(", ic AS", ", ic_unused AS"), f"SELECT lg.g, lg.t, lg.d AS dyad, CAST(l AS BIGINT) AS lag, round(least(abs(lg.im) * {N} / sqrt(x.e * y.e), 1e0), 6) AS imcoh FROM lg JOIN en x ON x.g = lg.g AND x.t = lg.t AND x.p = CAST(substr(lg.d, 5, 1) AS BIGINT) - 1 JOIN en y ON y.g = lg.g AND y.t = lg.t AND y.p = CAST(substr(lg.d, 6, 1) AS BIGINT) - 1 WHERE x.e * y.e > 1e-20"),
        "edge_index": "SELECT a.p AS channel1, b.p AS channel2, a.p * 3 + b.p AS edge FROM (SELECT DISTINCT p FROM sg) a CROSS JOIN (SELECT DISTINCT p FROM sg) b",
        "plv_descriptives": "SELECT d AS dyad, count(*) AS n, round(avg(plv), 6) AS mean, round(PCT(plv, 0.5), 6) AS median, round(stddev_samp(plv), 6) AS sd, bool_and(plv >= 0 AND plv <= 1 + 1e-9) AS bounded FROM plv GROUP BY d",
    }
    out = {k: "WITH" + BASE + (v[0] + "\n" + v[1] if isinstance(v, tuple) else "\n" + v) for k, v in q.items()}
    out["plv_sensor_edges"] = "WITH" + SENSORS + f"""
SELECT a.g, a.t, concat('pair', a.p + 1, b.p + 1) AS dyad, a.c AS channel1, b.c AS channel2, a.c * {CHANNELS} + b.c AS edge,
  round(sqrt(pow(avg(a.re * b.re + a.im * b.im), 2) + pow(avg(a.im * b.re - a.re * b.im), 2)), 6) AS plv
FROM ph a JOIN ph b ON a.g = b.g AND a.t = b.t AND a.i = b.i AND a.p < b.p GROUP BY a.g, a.t, a.p, b.p, a.c, b.c"""
    return out


#: The sensor form of a signal: CHANNELS channels of as many samples, one after the other.
CHANNELS = 4
#: The composed chain: bands and window of 64-sample signals at 64 Hz.
RATE, BANDS, ANCHOR, WINDOW, PAD = 64.0, {"theta": (4.0, 8.0), "alpha": (8.0, 13.0)}, 8, (0.125, 0.625), 0.5

#: PLV of every channel of one participant with every channel of another, by DFT sums of a channel's samples.
SENSORS = f"""
sg AS (
  SELECT CAST(floor(vec_id / 30) AS BIGINT) AS g, CAST(floor(vec_id % 30 / 3) AS BIGINT) AS t, vec_id % 3 AS p, CAST(floor(i / {N // CHANNELS}) AS BIGINT) AS c, i % {N // CHANNELS} AS i, x FROM UNROLL({{embeddings}}, vec_id, embedding) e
), hk AS (
  SELECT r AS n, CASE WHEN r % 2 = 1 THEN 2e0 / {N // CHANNELS} * cos(pi() * r / {N // CHANNELS}) / sin(pi() * r / {N // CHANNELS}) ELSE 0e0 END AS h FROM SERIES({N // CHANNELS}) s
), an AS (
  SELECT a.g, a.t, a.p, a.c, a.i, max(a.x) AS re, sum(b.x * h) AS im
  FROM sg a JOIN sg b ON a.g = b.g AND a.t = b.t AND a.p = b.p AND a.c = b.c JOIN hk ON hk.n = (a.i - b.i + {N // CHANNELS}) % {N // CHANNELS} GROUP BY a.g, a.t, a.p, a.c, a.i
), ph AS (SELECT g, t, p, c, i, re / sqrt(re * re + im * im) AS re, im / sqrt(re * re + im * im) AS im FROM an
)"""


def filter_sql(source: str, bands: dict[str, tuple[float, float]], rate: float, name: str, order: int = 4) -> str:
    """Steps that filter lists sample by sample, forward and backward; the last is `name` (band, id, xs), for each of source's (id, xs)."""
    rows = []
    for band, (low, high) in bands.items():
        for k, (bk, ak) in enumerate(zip(*filters.butterworth(order, rate, low, high), strict=True)):
            # the states that a constant 1 settles to
            gain = bk.sum() / ak.sum()
            s2 = bk[2] - ak[2] * gain
            rows.append(f"('{band}', {k}, {bk[0]!r}, {bk[1]!r}, {bk[2]!r}, {ak[1]!r}, {ak[2]!r}, {bk[1] - ak[1] * gain + s2!r}, {s2!r})".replace("np.float64(", "(").replace("((", "(("))
    values = ", ".join(rows)
    steps = [f"{name}_c(band, k, b0, b1, b2, a1, a2, t1, t2) AS (VALUES {values})", f"{name}_0 AS (SELECT band, id, xs FROM {source} CROSS JOIN (SELECT DISTINCT band FROM {name}_c))"]
    for j in range(2 * order):
        put = "b0 * x + s1"
        move = f"{put} AS y, b1 * x - a1 * ({put}) + s2 AS n1, b2 * x - a2 * ({put}) AS n2"
        steps.append(f"""{name}_r{j}(band, id, i, y, s1, s2) AS (
  SELECT band, id, 1, y, n1, n2 FROM (SELECT band, id, {move} FROM (SELECT q.band, id, b0, b1, b2, a1, a2, xs[1] AS x, t1 * xs[1] AS s1, t2 * xs[1] AS s2 FROM {name}_{j} q JOIN {name}_c c ON c.band = q.band AND c.k = {j % order}))
  UNION ALL
  SELECT band, id, i, y, n1, n2 FROM (SELECT band, id, i, {move} FROM (SELECT r.band, r.id, r.i + 1 AS i, b0, b1, b2, a1, a2, xs[r.i + 1] AS x, s1, s2
    FROM {name}_r{j} r JOIN {name}_{j} q ON q.band = r.band AND q.id = r.id JOIN {name}_c c ON c.band = r.band AND c.k = {j % order} WHERE r.i < len(xs)))
)""")
        order_by = "i DESC" if j in (order - 1, 2 * order - 1) else "i"
        steps.append(f"{name if j == 2 * order - 1 else f'{name}_{j + 1}'} AS (SELECT band, id, list(y ORDER BY {order_by}) AS xs FROM {name}_r{j} GROUP BY band, id)")
    return ", ".join(steps)


def chain_sql() -> str:
    """Steps of the composed chain; the last is bz (g, t, p, band, i, re, im), amplitudes kept."""
    pad, begin, end = round(PAD * RATE), ANCHOR + round(WINDOW[0] * RATE), ANCHOR + round(WINDOW[1] * RATE)
    n = N + 2 * pad
    return f"""pz AS (
  SELECT vec_id AS id, list(CAST(embedding[1 + CASE WHEN j < {pad} THEN {pad} - j WHEN j < {N + pad} THEN j - {pad} ELSE {2 * N + pad - 2} - j END] AS DOUBLE) ORDER BY j) AS xs
  FROM embeddings CROSS JOIN (SELECT range AS j FROM range({n})) GROUP BY vec_id
), {filter_sql("pz", BANDS, RATE, "ft")}, fs AS (
  SELECT band, id, generate_subscripts(xs, 1) - 1 AS i, unnest(xs) AS x FROM ft
), hn AS (
  SELECT range AS n, CASE WHEN range % 2 = 1 THEN 2e0 / {n} * cos(pi() * range / {n}) / sin(pi() * range / {n}) ELSE 0e0 END AS h FROM range({n})
), bz AS (
  SELECT CAST(floor(a.id / 30) AS BIGINT) AS g, CAST(floor(a.id % 30 / 3) AS BIGINT) AS t, a.id % 3 AS p, a.band, a.i - {pad + begin} AS i, max(a.x) AS re, sum(b.x * h) AS im
  FROM fs a JOIN fs b ON b.band = a.band AND b.id = a.id JOIN hn ON hn.n = (a.i - b.i + {n}) % {n} WHERE a.i >= {pad + begin} AND a.i < {pad + end} GROUP BY a.id, a.band, a.i
), bu AS (
  SELECT g, t, p, band, i, CASE WHEN re * re + im * im > 0 THEN re / sqrt(re * re + im * im) ELSE 0 END AS re, CASE WHEN re * re + im * im > 0 THEN im / sqrt(re * re + im * im) ELSE 0 END AS im FROM bz
)"""


def oracles() -> dict[str, str]:
    """SQL of the queries whose text is DuckDB's alone."""
    pair = "a.g = b.g AND a.t = b.t AND a.band = b.band AND a.i = b.i AND a.p < b.p"
    who = "a.g, a.t, a.band, concat('pair', a.p + 1, b.p + 1) AS dyad"
    return {
        "butterworth_bandpass": f"WITH RECURSIVE sq AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS xs FROM embeddings), {filter_sql('sq', {'theta': (4.0, 8.0)}, 64.0, 'ft')} SELECT id AS vec_id, generate_subscripts(xs, 1) - 1 AS i, round(unnest(xs), 6) AS filtered FROM ft",
        "phase_tensor": f"WITH RECURSIVE {chain_sql()} SELECT g, t, p, band, i, round(re, 6) AS re, round(im, 6) AS im FROM bu",
        "band_plv_pairs": f"WITH RECURSIVE {chain_sql()} SELECT {who}, round(sqrt(pow(avg(a.re * b.re + a.im * b.im), 2) + pow(avg(a.im * b.re - a.re * b.im), 2)), 6) AS plv FROM bu a JOIN bu b ON {pair} GROUP BY a.g, a.t, a.band, a.p, b.p",
        "band_imcoh_pairs": f"""WITH RECURSIVE {chain_sql()} SELECT {who}, round(CASE WHEN sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im) > 1e-20
  THEN least(abs(sum(a.im * b.re - a.re * b.im)) / sqrt(sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im)), 1e0) ELSE 0e0 END, 6) AS imcoh FROM bz a JOIN bz b ON {pair} GROUP BY a.g, a.t, a.band, a.p, b.p""",
    }


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g, t, p, x: one row a signal."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = F.col("vec_id")
    return e.select(F.floor(v / 30).alias("g"), F.floor(v % 30 / 3).alias("t"), (v % 3).alias("p"), F.col("embedding").alias("x"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g, t, v0, v1, v2: one row a trial, the signals of its three participants (null where one is missing)."""
    return signals(spark, sf_dir).groupBy("g", "t").agg(*(F.max(F.when(F.col("p") == p, F.col("x"))).alias(f"v{p}") for p in range(3)))


def dyads(rows: DataFrame, keys: list[str], first: str = "v", second: str = "v", every: bool = False) -> DataFrame:
    """keys, d, a, z: one row for each pair of participants (with `every` also of one with itself, in both orders)."""
    of = [(a, z) for a in range(3) for z in range(3) if every or a < z]
    both = F.array(*(F.struct(F.lit(f"pair{a + 1}{z + 1}").alias("d"), F.col(f"{first}{a}").alias("a"), F.col(f"{second}{z}").alias("z")) for a, z in of))
    return rows.select(*keys, F.explode(both).alias("q")).select(*keys, "q.d", "q.a", "q.z")


def pair_values(spark: SparkSession, sf_dir: str, lags: bool = False) -> DataFrame:
    """g, t, d, plv, imcoh of every pair of a trial; arrays by lag with lags."""
    return phase.pairs(dyads(trials(spark, sf_dir), ["g", "t"]), ["g", "t", "d"], "a", "z", lags)


def _samples(df: DataFrame) -> DataFrame:
    return df.select("g", "t", "p", F.posexplode(F.arrays_zip("re", "im")).alias("i", "z")).select("g", "t", "p", "i", F.round("z.re", 6).alias("re"), F.round("z.im", 6).alias("im"))


def _lags(df: DataFrame, value: str) -> DataFrame:
    each = df.select("g", "t", F.col("d").alias("dyad"), F.posexplode(value).alias("lag", "x")).where(~F.isnan("x"))
    return each.select("g", "t", "dyad", F.col("lag").cast("long").alias("lag"), F.round("x", 6).alias(value))


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, got = F.col("d"), phase.pairs(dyads(trials(spark, sf_dir), ["g", "t"], every=True), ["g", "t", "d"], "a", "z")
    at = lambda k: (F.substring(d, k, 1).cast("long") - 1)
    return got.select("g", "t", at(5).alias("channel1"), at(6).alias("channel2"), F.round("plv", 6).alias("plv"))


def _sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = phase.sensor_edges(dyads(trials(spark, sf_dir), ["g", "t"]), ["g", "t", "d"], "a", "z", CHANNELS)
    each = edges.select("g", "t", F.col("d").alias("dyad"), F.posexplode("edges").alias("edge", "plv"))
    one, two = F.floor(F.col("edge") / CHANNELS), F.col("edge") % CHANNELS
    return each.select("g", "t", "dyad", one.alias("channel1"), two.cast("long").alias("channel2"), F.col("edge").cast("long").alias("edge"), F.round("plv", 6).alias("plv"))


def tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g, t, p, band, re, im: padded, filtered, transformed, cut and normalised in one pass."""
    return phase.phase_tensor(signals(spark, sf_dir), ["g", "t", "p"], "x", RATE, BANDS, ANCHOR, WINDOW, pad_seconds=PAD)


def chain(band: str) -> dict:
    return {"rate": RATE, "band": BANDS[band], "anchor": ANCHOR, "window": WINDOW, "pad_seconds": PAD}


def band_pairs(spark: SparkSession, sf_dir: str, lags: bool = False, bands: list[str] | None = None) -> DataFrame:
    """g, t, d, band, plv, imcoh of every pair of a trial from band signals that pass the chain; coherency keeps amplitudes."""
    rows = dyads(trials(spark, sf_dir), ["g", "t"])
    each = [phase.pairs(rows, ["g", "t", "d"], "a", "z", lags, chain(band)).withColumn("band", F.lit(band)) for band in bands or BANDS]
    return reduce(DataFrame.unionByName, each)


def _band_pair(value: str):
    return lambda spark, sf_dir: band_pairs(spark, sf_dir).select("g", "t", "band", F.col("d").alias("dyad"), F.round(value, 6).alias(value))


def _tensor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tensor(spark, sf_dir).select("g", "t", "p", "band", F.posexplode(F.arrays_zip("re", "im")).alias("i", "z"))
    return rows.select("g", "t", "p", "band", "i", F.round("z.re", 6).alias("re"), F.round("z.im", 6).alias("im"))


def _filtered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.bandpass(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 64.0, 4.0, 8.0)
    return rows.select("vec_id", F.posexplode("filtered").alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("filtered"))


def frames() -> dict:
    """Queries in the form for Spark."""
    pair = lambda spark, sf_dir, name: pair_values(spark, sf_dir).select("g", "t", F.col("d").alias("dyad"), F.round(name, 6).alias(name))
    return {
        "butterworth_bandpass": _filtered_rows,
        "hilbert_phase": lambda spark, sf_dir: _samples(phase.analytic_signals(signals(spark, sf_dir), ["g", "t", "p"], "x", phase=True)),
        "band_analytic": lambda spark, sf_dir: _samples(phase.analytic_signals(signals(spark, sf_dir), ["g", "t", "p"], "x", 4, 8)),
        "plv_pairs": lambda spark, sf_dir: pair(spark, sf_dir, "plv"),
        "imcoh_pairs": lambda spark, sf_dir: pair(spark, sf_dir, "imcoh"),
        "plv_all_lags": lambda spark, sf_dir: _lags(pair_values(spark, sf_dir, True), "plv"),
        "imcoh_all_lags": lambda spark, sf_dir: _lags(pair_values(spark, sf_dir, True), "imcoh"),
        "plv_channel_matrix": _channels,
        "plv_sensor_edges": _sensors,
        "phase_tensor": _tensor_rows,
        "band_plv_pairs": _band_pair("plv"),
        "band_imcoh_pairs": _band_pair("imcoh"),
    }
