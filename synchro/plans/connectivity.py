"""Four nulls of the synchrony and coherency contrasts of array signals, and the rule that all must reject.

Signals are those of `signals`; the ten trials of a group are one block, and a trial is positive if all
three labels are below 7.  Units are pairs of participants by measure (plv, imcoh).  A group without
both classes has no weight.  A trial that a surrogate partner lacks adds nothing to that realization.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import derange, draws, partners, phase
from ..operators.ranks import numbered
from ..sources.scratch import saved
from . import dialect, inference, nulls, signals

#: Realizations of each null, as published for candidates, and samples that a lag moves at least.
DRAWS, NEAR = 1_000, 10
N = signals.N

LABELS = """, tt AS (
  SELECT CAST(floor(vec_id / 30) AS BIGINT) AS g, CAST(floor(vec_id % 30 / 3) AS BIGINT) AS t, min(CASE WHEN label < 7 THEN 1 ELSE 0 END) AS y
  FROM {embeddings} GROUP BY 1, 2 HAVING count(*) = 3
), w AS (
  SELECT g, CAST(sum(y) AS BIGINT) AS n1, CAST(count(*) - sum(y) AS BIGINT) AS n0, sum(y) * (count(*) - sum(y)) * 1e0 / count(*) AS w
  FROM tt GROUP BY g HAVING sum(y) > 0 AND sum(y) < count(*)
), tot AS (SELECT sum(w) AS w_all FROM w
), co AS (
  SELECT tt.g, tt.t, w / w_all * CASE WHEN y = 1 THEN 1e0 / n1 ELSE -1e0 / n0 END AS k FROM tt JOIN w ON w.g = tt.g CROSS JOIN tot
), ux AS (
  SELECT g, t, concat(d, '|plv') AS u, plv AS x FROM plv UNION ALL SELECT g, t, concat(d, '|imcoh') AS u, icoh AS x FROM ic
), ob AS (SELECT u, sum(x * k) AS effect FROM ux JOIN co ON co.g = ux.g AND co.t = ux.t GROUP BY u
)"""

BASE = signals.BASE + signals.COHERENCY + LABELS

#: The band of the nulls on band signals, and samples of its window.
BAND, WINDOW_SAMPLES = "theta", (signals.WINDOW[1] - signals.WINDOW[0]) * signals.RATE
SEEDS = {"label": 41, "time": 43, "partner": 19, "dyad": 47}
NAMES = [f"{d}|{m}" for m in ("plv", "imcoh") for d in inference.PAIRS]
_UNIT = "CASE {} " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(NAMES)) + " END"

# The nulls as SQL, what DuckDB runs; `frames` has the form for Spark.

#: Allocation number h % c of a group's c label allocations, for all units alike.
LABEL = f""", mk AS (
  SELECT n, mask, ones, row_number() OVER (PARTITION BY n, ones ORDER BY mask DESC) - 1 AS place, count(*) OVER (PARTITION BY n, ones) AS c
  FROM (SELECT a.r + 1 AS n, m.r AS mask, bit_count(m.r) AS ones FROM SERIES(10) a JOIN SERIES(1024) m ON m.r < (1 << (a.r + 1)::INT)) q
), tp AS (SELECT g, t, row_number() OVER (PARTITION BY g ORDER BY t) AS place FROM tt
), {draws.stream_sql("w", SEEDS["label"], ["g"], ["n1", "n0"], DRAWS)}, pk AS (
  SELECT hs.r, tp.g, tp.t, CASE WHEN (mask >> (hs.n1 + hs.n0 - tp.place)::INT) & 1 = 1 THEN hs.n0 ELSE -hs.n1 END * 1e0 / (hs.n1 + hs.n0) / w_all AS k
  FROM hs JOIN mk ON mk.n = hs.n1 + hs.n0 AND mk.ones = hs.n1 AND mk.place = h % mk.c JOIN tp ON tp.g = hs.g CROSS JOIN tot
), nu AS (SELECT r, u, sum(x * k) AS e FROM pk JOIN ux ON ux.g = pk.g AND ux.t = pk.t GROUP BY r, u
)"""

#: One lag for each realization, trial and unit; lags nearer than NEAR samples to no shift are not valid.
def time_steps(n: int) -> str:
    lags = signals.lags_sql(n)
    return lags.replace("SRC", "ph").replace("lg AS", "lp AS") + lags.replace("SRC", "an").replace("lg AS", "lc AS") + f""", lv AS (
  SELECT g, t, concat(d, '|plv') AS u, l, sqrt(re * re + im * im) AS x FROM lp UNION ALL
  SELECT lc.g, lc.t, concat(d, '|imcoh') AS u, l, CASE WHEN a.e * b.e > 1e-20 THEN least(abs(im) * {n} / sqrt(a.e * b.e), 1e0) ELSE 0e0 END AS x
  FROM lc JOIN en a ON a.g = lc.g AND a.t = lc.t AND lc.d LIKE concat('pair', a.p + 1, '_') JOIN en b ON b.g = lc.g AND b.t = lc.t AND lc.d LIKE concat('pair_', b.p + 1)
), {draws.stream_sql("co", SEEDS["time"], ["g", "t"], ["k"], DRAWS, 6)}, la AS (SELECT r, g, t, k, {_UNIT.format("ui")} AS u, {NEAR} + h % {n - 2 * NEAR + 1} AS l FROM hs
), nu AS (SELECT r, la.u, sum(x * k) AS e FROM la JOIN lv ON lv.g = la.g AND lv.t = la.t AND lv.l = la.l AND lv.u = la.u GROUP BY r, la.u
)"""


TIME = time_steps(N)

#: The first of a pair meets the second of another group at the same trial; labels stay with the first.  Every unit has derangements of its own.
PARTNER = f""", zz AS (
  SELECT an.g, an.t, an.p, an.i, an.re, an.im, ph.re AS pre, ph.im AS pim FROM an JOIN ph ON ph.g = an.g AND ph.t = an.t AND ph.p = an.p AND ph.i = an.i
), {derange.derangements_sql("tt", DRAWS, SEEDS["partner"], 6)}, hp AS (SELECT DISTINCT g, h FROM de
), xs AS (
  SELECT hp.g, hp.h, a.t, concat('pair', a.p + 1, b.p + 1) AS d, avg(a.pre * b.pre + a.pim * b.pim) AS re, avg(a.pim * b.pre - a.pre * b.pim) AS im,
    sum(a.im * b.re - a.re * b.im) AS c, sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im) AS e
  FROM hp JOIN zz a ON a.g = hp.g JOIN zz b ON b.g = hp.h AND b.t = a.t AND b.i = a.i AND a.p < b.p GROUP BY hp.g, hp.h, a.t, a.p, b.p
), xv AS (
  SELECT g, h, t, concat(d, '|plv') AS u, sqrt(re * re + im * im) AS x FROM xs UNION ALL
  SELECT g, h, t, concat(d, '|imcoh') AS u, CASE WHEN e > 1e-20 THEN least(abs(c) / sqrt(e), 1e0) ELSE 0e0 END AS x FROM xs
), hv AS (SELECT xv.g, h, u, sum(x * k) AS x FROM xv JOIN co ON co.g = xv.g AND co.t = xv.t GROUP BY xv.g, h, u
), nu AS (SELECT de.r, u, sum(x) AS e FROM de JOIN hv ON hv.g = de.g AND hv.h = de.h AND hv.u = {_UNIT.format("de.f")} GROUP BY de.r, u
)"""

#: Each trial's pair is drawn from the group's three, the observed one included; every unit draws for itself.
DYAD = f""", {draws.stream_sql("co", SEEDS["dyad"], ["g", "t"], ["k"], DRAWS, 6)}, pd AS (
  SELECT r, g, t, k, {_UNIT.format("ui")} AS u, {_UNIT.format("h % 3 + 3 * CAST(floor(ui / 3) AS BIGINT)")} AS taken FROM hs
), nu AS (SELECT r, pd.u, sum(x * k) AS e FROM pd JOIN ux ON ux.g = pd.g AND ux.t = pd.t AND ux.u = pd.taken GROUP BY r, pd.u
)"""

NULLS = {"label": LABEL, "time": TIME, "partner": PARTNER, "dyad": DYAD}


def _own_names(sql: str, null: str) -> str:
    """The null's last steps under names of their own, so that several nulls fit one text."""
    return re.sub(r"\b(xw|mk|pk|pd|bl|nw|nu|hs\w*|st|nz|mx|mt)\b", rf"\1_{null}", sql)


#: A unit passes if each null rejects it; a null that gives it no value does not.
LAYERS = """SELECT label.u AS unit, round(label.effect, 6) AS effect, round(label.p_max, 6) AS p_label, round(time_.p_max, 6) AS p_time,
  round(partner.p_max, 6) AS p_partner, round(dyad.p_max, 6) AS p_dyad, label.p_max < 0.05 AS label_pass,
  coalesce(time_.p_max < 0.05 AND partner.p_max < 0.05, false) AS secondary_pass,
  label.p_max < 0.05 AND coalesce(time_.p_max < 0.05 AND partner.p_max < 0.05 AND dyad.p_max < 0.05, false) AS all_pass
FROM mt_label label LEFT JOIN mt_time time_ ON time_.u = label.u LEFT JOIN mt_partner partner ON partner.u = label.u LEFT JOIN mt_dyad dyad ON dyad.u = label.u"""

#: Units that are left after each layer, in the order of the layers.
FUNNEL = """SELECT count(*) AS searched, CAST(sum(CASE WHEN label.p_raw < 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS raw_pass,
  CAST(sum(CASE WHEN label.p_max < 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS label_pass,
  CAST(sum(CASE WHEN label.p_max < 0.05 AND time_.p_max < 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS time_pass,
  CAST(sum(CASE WHEN label.p_max < 0.05 AND time_.p_max < 0.05 AND partner.p_max < 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS partner_pass,
  CAST(sum(CASE WHEN label.p_max < 0.05 AND time_.p_max < 0.05 AND partner.p_max < 0.05 AND dyad.p_max < 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS dyad_pass
FROM mt_label label LEFT JOIN mt_time time_ ON time_.u = label.u LEFT JOIN mt_partner partner ON partner.u = label.u LEFT JOIN mt_dyad dyad ON dyad.u = label.u"""


def texts() -> dict[str, str]:
    q = {f"connectivity_{null}_null_maxt": sql + inference.MAXT + "\n" + inference.SHOW_MAXT for null, sql in NULLS.items()}
    q["connectivity_effects"] = "\nSELECT u AS unit, round(effect, 6) AS effect FROM ob"
    out = {name: "WITH" + BASE + text for name, text in q.items()}

    # the four nulls of all units on the event stream, held against one another
    out |= layer_texts(inference.STEPS)
    return out


def layer_texts(steps: dict[str, str]) -> dict[str, str]:
    text = inference.BASE + "".join(_own_names(steps[null] + inference.MAXT, null) for null in NULLS)
    return {name: "WITH" + text + "\n" + show for name, show in (("four_layers", LAYERS), ("attrition_funnel", FUNNEL))}


#: The same steps for Spark: values of pairs come from FFT over arrays, and draws pick among a trial's or a group's sums.
_PAIRS = """
plv AS (SELECT g, t, d, plv FROM {pair_values}), ic AS (SELECT g, t, d, imcoh AS icoh FROM {pair_values})"""
_GIVEN = ", nu AS (SELECT r, u, e FROM {nu_rows})"
_VALUES = [f"x{i}" for i in range(len(NAMES))]


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g, t, y, kw (the trial's coefficient times the sum of weights), w_all: trials of groups with both classes."""
    labels = LABELS[LABELS.index("tt AS (") : LABELS.index("), co AS (")] + ")"
    text = f"WITH {labels} SELECT tt.g, tt.t, tt.y, CASE WHEN y = 1 THEN n0 ELSE -n1 END * 1e0 / (n1 + n0) AS kw, w_all FROM tt JOIN w ON w.g = tt.g CROSS JOIN tot"
    return dialect.run(spark, sf_dir, text)


def _wide(values: DataFrame) -> DataFrame:
    """g, t, x0..: the units of a trial as columns, numbers or arrays by lag."""
    of = [(d, m) for m in ("plv", "imcoh") for d in inference.PAIRS]
    return values.groupBy("g", "t").agg(*(F.max(F.when(F.col("d") == d, F.col(m))).alias(x) for x, (d, m) in zip(_VALUES, of, strict=True)))


def _numbers(batch, columns: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)


def _keys(batch, columns: tuple[str, ...]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]


def _label_score(batch) -> Iterator[draws.Scored]:
    for rows, m in nulls.matrices(batch, ("y", *_VALUES)):
        yield from nulls.by_positives([k[rows] for k in _keys(batch, ("g",))], m["y"], np.stack([m[x] for x in _VALUES], axis=2))


def _time_score(batch) -> Iterator[draws.Scored]:
    kw, keys = batch.column("kw").to_numpy(zero_copy_only=False), _keys(batch, ("g", "t"))
    for rows, m in nulls.matrices(batch, tuple(_VALUES), "x0"):
        x = np.nan_to_num(np.stack([m[c] for c in _VALUES], axis=2))  # without energy there is no coherency
        n = x.shape[1]
        if n < 2 * NEAR:
            raise ValueError(f"signals of {n} samples have no lag that is {NEAR} samples from no shift")
        yield draws.choices([k[rows] for k in keys], kw[rows][:, None, None] * x[:, NEAR : n - NEAR + 1])


def _dyad_score(batch) -> Iterator[draws.Scored]:
    if batch.num_rows:
        yield draws.choices(_keys(batch, ("g", "t")), nulls.dyad_sums(_numbers(batch, ["kw"])[:, 0], _numbers(batch, _VALUES)))


def _pair_values(spark: SparkSession, sf_dir: str, lags: bool, band: str | None) -> DataFrame:
    if band:
        return signals.band_pairs(spark, sf_dir, lags, [band])
    return signals.pair_values(spark, sf_dir, lags)


def _null(spark: SparkSession, sf_dir: str, kind: str, band: str | None = None) -> DataFrame:
    """r, u, e: the realizations of a null, of every unit; of signals as they are, or in a band."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    trials = _weighted(spark, sf_dir)
    if kind == "partner":
        rows = _partners(spark, sf_dir, trials, band)
    else:
        blocks = trials.join(_wide(_pair_values(spark, sf_dir, kind == "time", band)), ["g", "t"])
        if kind == "label":
            blocks = blocks.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("t", "y", *_VALUES))).alias("s"))  # ten trials a group
            blocks = blocks.select("g", *(F.expr(f"transform(s, x -> CAST(x.{c} AS DOUBLE))").alias(c) for c in ("y", *_VALUES)))
        score = {"label": _label_score, "time": _time_score, "dyad": _dyad_score}[kind]
        rows = draws.picked(blocks.repartition(partitions, "g"), score, NAMES, DRAWS, SEEDS[kind], kind == "label")
    total = trials.select("w_all").limit(1)
    return rows.crossJoin(F.broadcast(total)).select("r", "u", (F.col("e") / F.col("w_all")).alias("e"))  # total has one row


def _partners(spark: SparkSession, sf_dir: str, trials: DataFrame, band: str | None = None) -> DataFrame:
    """r, u, e: sums over partners; signals are transformed where they meet, so none is sent but as it is."""
    text = "WITH" + LABELS[LABELS.index(" tt AS (") : LABELS.index("), w AS (")] + ") SELECT DISTINCT g FROM tt"
    groups = saved(numbered(dialect.run(spark, sf_dir, text), [F.col("g")]), "groups")
    n, rows = groups.count(), saved(signals.trials(spark, sf_dir).join(groups, "g"), "trials")
    chosen = derange.chosen(groups, n, DRAWS, SEEDS["partner"], len(NAMES)) if n else [[]] * len(NAMES)
    of = [(p, coherency) for coherency in (False, True) for p in inference.PAIRS.values()]
    first, second = (F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(pair[k]).cast("array<double>").alias("x")) for f, (pair, _) in enumerate(of)))).alias("q") for k in (0, 1))
    mine = rows.join(trials.select("g", "t", F.array("kw").alias("kw")), ["g", "t"]).select("i", "t", "kw", first).select("q.f", "i", "t", "kw", "q.x")
    theirs = rows.select("i", "t", second).select("q.f", "i", "t", "q.x")
    how = signals.chain(band) if band else None
    transform = (lambda x: phase.band_analytic(x, **how)) if how else phase.analytic
    got = partners.summed(mine, theirs, n, chosen, SEEDS["partner"], [partners.synchrony(transform, coherency) for _, coherency in of])
    return got.select("r", F.expr(_UNIT.format("f")).alias("u"), "e")


def frames() -> dict:
    """The nulls in the form for Spark."""

    def run(text: str, kind: str | None = None, band: str | None = None):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            given = {"pair_values": _pair_values(spark, sf_dir, False, band)}
            if kind:
                given["nu_rows"] = _null(spark, sf_dir, kind, band)
            return dialect.run(spark, sf_dir, "WITH" + _PAIRS + LABELS + text, **given)

        return query

    def layers(text: str):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return dialect.run(spark, sf_dir, text, **{f"{kind}_rows": nulls.null(kind)(spark, sf_dir) for kind in NULLS})

        return query

    show = inference.MAXT + "\n" + inference.SHOW_MAXT
    maxt = {f"connectivity_{kind}_null_maxt": run(_GIVEN + show, kind) for kind in NULLS} | {f"band_{kind}_null_maxt": run(_GIVEN + show, kind, BAND) for kind in NULLS}
    layered = {name: layers(text) for name, text in layer_texts({kind: f", nu AS (SELECT r, u, e FROM {{{kind}_rows}})" for kind in NULLS}).items()}
    found = maxt | layered | {"connectivity_effects": run("\nSELECT u AS unit, round(effect, 6) AS effect FROM ob")}

    def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Per pair of participants both measures' effects, whether their signs agree, and each measure's passes."""
        rows = found["connectivity_label_null_maxt"](spark, sf_dir).select("unit", "effect", F.col("p_maxt").alias("label"))
        for null in ("time", "partner", "dyad"):
            rows = rows.join(found[f"connectivity_{null}_null_maxt"](spark, sf_dir).select("unit", F.col("p_maxt").alias(null)), "unit", "left")
        passed = [F.coalesce(F.col(n) < 0.05, F.lit(False)).alias(n) for n in NULLS]
        rows = rows.select(F.split_part("unit", F.lit("|"), F.lit(1)).alias("dyad_of"), F.split_part("unit", F.lit("|"), F.lit(2)).alias("m"), "effect", *passed)
        of = lambda m, x: F.max(F.when(F.col("m") == m, F.col(x)))
        flags = [of(m, n).alias(f"{m}_{n}_pass") for m in ("plv", "imcoh") for n in NULLS]
        return rows.groupBy(F.col("dyad_of").alias("pair")).agg(of("plv", "effect").alias("plv"), of("imcoh", "effect").alias("imcoh"), (F.signum(of("plv", "effect")) == F.signum(of("imcoh", "effect"))).alias("agrees"), *flags)

    return found | {"metric_agreement": agreement}


def band_texts() -> dict[str, str]:
    """The nulls of band signals: phases and amplitudes from the chain, by recursion over samples."""
    n = round(WINDOW_SAMPLES)
    base = signals.chain_sql() + f""", an AS (SELECT g, t, p, i, re, im FROM bz WHERE band = '{BAND}'
), ph AS (SELECT g, t, p, i, re, im FROM bu WHERE band = '{BAND}'
), {signals.BASE[signals.BASE.index("cr AS ("):].strip()}{signals.COHERENCY}{LABELS}"""
    steps = NULLS | {"time": time_steps(n)}
    return {f"band_{kind}_null_maxt": "WITH RECURSIVE " + base + steps[kind] + inference.MAXT + "\n" + inference.SHOW_MAXT for kind in NULLS}


def oracles() -> dict[str, str]:
    own = texts()
    joins = " ".join(f"LEFT JOIN ({dialect.duckdb_text(own[f'connectivity_{n}_null_maxt'])}) {n}_ ON {n}_.unit = label_.unit" for n in ("time", "partner", "dyad"))
    flags = ", ".join(f"bool_or(m = '{m}' AND {n}) AS {m}_{n}_pass" for m in ("plv", "imcoh") for n in NULLS)
    passed = ", ".join(f"coalesce({n}_.p_maxt < 0.05, false) AS {n}" for n in NULLS)
    return {name: dialect.duckdb_text(text) for name, text in band_texts().items()} | {
        "metric_agreement": f"""WITH r AS (
  SELECT split_part(label_.unit, '|', 1) AS pair, split_part(label_.unit, '|', 2) AS m, label_.effect, {passed} FROM ({dialect.duckdb_text(own["connectivity_label_null_maxt"])}) label_ {joins}
)
SELECT pair, max(CASE WHEN m = 'plv' THEN effect END) AS plv, max(CASE WHEN m = 'imcoh' THEN effect END) AS imcoh, sign(max(CASE WHEN m = 'plv' THEN effect END)) = sign(max(CASE WHEN m = 'imcoh' THEN effect END)) AS agrees, {flags}
FROM r GROUP BY pair"""
    }
