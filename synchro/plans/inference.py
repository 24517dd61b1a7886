"""Queries of the inference pipeline on the event stream: labels, contrasts, nulls, family-wise error.

Users are participants, three to a group; a user's events in order of time are trials, ten to a
block; a trial is positive if all three participants cooperate.  A unit is a pair of participants
and a measure of how close their values are.  Randomness is an integer hash, so engines agree.
"""

from __future__ import annotations

from ..operators import derange, draws

#: A trial carries the counts n1 and n0 of its block, its unnormalised coefficient kw (0 in a block without
#: both classes) and wn, its part of the block's weight: effects are sum(x * kw) / sum(wn), without a join.
BASE = """
tr AS (
  SELECT CAST(floor(user_id / 3) AS BIGINT) AS g, user_id % 3 AS p,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
    CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 1 ELSE 0 END AS c, value AS v
  FROM {events}
), tt AS (
  SELECT g, t, CAST(floor(t / 10) AS BIGINT) AS b, min(c) AS y, max(CASE WHEN p = 0 THEN v END) AS v0,
    max(CASE WHEN p = 1 THEN v END) AS v1, max(CASE WHEN p = 2 THEN v END) AS v2
  FROM tr GROUP BY g, t HAVING count(*) = 3
), tn AS (
  SELECT g, t, b, y, v0, v1, v2, CAST(sum(y) OVER (PARTITION BY g, b) AS BIGINT) AS n1, CAST(count(*) OVER (PARTITION BY g, b) - sum(y) OVER (PARTITION BY g, b) AS BIGINT) AS n0
  FROM (SELECT SPREAD(g, b) g, t, b, y, v0, v1, v2 FROM tt) q
), tw AS (
  SELECT g, t, b, y, v0, v1, v2, n1, n0, CASE WHEN y = 1 THEN n0 ELSE -n1 END * 1e0 / (n1 + n0) AS kw, n1 * n0 * 1e0 / (n1 + n0) / (n1 + n0) AS wn FROM tn
), bw AS (
  SELECT g, b, CAST(sum(y) AS BIGINT) AS n1, CAST(count(*) - sum(y) AS BIGINT) AS n0 FROM tt GROUP BY g, b
), w AS (
  SELECT g, b, n1, n0, n1 * n0 * 1e0 / (n1 + n0) AS w FROM bw WHERE n1 > 0 AND n0 > 0
), tot AS (SELECT sum(wn) AS w_all FROM tw
), ux AS (
  SELECT g, t, b, y, n1, n0, kw, wn, d, concat(d, '|', measure) AS u,
    CASE WHEN measure = 'closeness' THEN 1e0 / (1e0 + abs(a - z)) ELSE (least(a, z) + 1e0) / (greatest(a, z) + 1e0) END AS x
  FROM (
    SELECT tw.*, CASE WHEN r % 3 = 0 THEN 'pair12' WHEN r % 3 = 1 THEN 'pair13' ELSE 'pair23' END AS d,
      CASE WHEN r < 3 THEN 'closeness' ELSE 'ratio' END AS measure, CASE WHEN r % 3 = 2 THEN v1 ELSE v0 END AS a, CASE WHEN r % 3 = 0 THEN v1 ELSE v2 END AS z
    FROM tw CROSS JOIN SERIES(6) k) q
), co AS (SELECT g, t, b, y, v0, v1, kw / w_all AS k FROM tw CROSS JOIN tot WHERE n1 > 0 AND n0 > 0
), gw AS (
  SELECT g, CAST(sum(y) AS BIGINT) AS n1, CAST(count(*) - sum(y) AS BIGINT) AS n0 FROM tt GROUP BY g
), gi AS (SELECT g, n1, n0, n1 * n0 * 1e0 / (n1 + n0) AS w FROM gw WHERE n1 > 0 AND n0 > 0
), be AS (
  SELECT u, g, b, avg(CASE WHEN y = 1 THEN x END) - avg(CASE WHEN y = 0 THEN x END) AS e, max(n1 * n0 * 1e0 / (n1 + n0)) AS w
  FROM ux WHERE n1 > 0 AND n0 > 0 GROUP BY u, g, b
), ge AS (SELECT u, g, sum(e * w) / sum(w) AS effect, sum(w) AS w FROM be GROUP BY u, g
), ob AS (SELECT u, sum(x * kw) / sum(wn) AS effect FROM ux GROUP BY u
)"""

#: Realizations of the label, time, partner and pair nulls.
LABELS, SHIFTS, PARTNERS, DYADS = 5_000, 1_000, 1_000, 500
SEEDS = {"label": 3100, "time": 1, "partner": 17, "dyad": 950001}

#: The six values of a trial, as columns: draws multiply trials, and units come back after the sums.
UNITS = [(d, m) for m in ("closeness", "ratio") for d in ("pair12", "pair13", "pair23")]
PAIRS = {"pair12": ("v0", "v1"), "pair13": ("v0", "v2"), "pair23": ("v1", "v2")}


def _value(unit: tuple[str, str], first: str = "", second: str = "") -> str:
    """A unit's value; first and second prefix the columns of the pair's two participants."""
    a, z = (p + v for p, v in zip((first, second), PAIRS[unit[0]], strict=True))
    return f"1e0 / (1e0 + abs({a} - {z}))" if unit[1] == "closeness" else f"(least({a}, {z}) + 1e0) / (greatest({a}, {z}) + 1e0)"


WIDE = "SELECT g, t, b, n1, n0, kw, wn, " + ", ".join(f"{_value(u)} AS x{i}" for i, u in enumerate(UNITS)) + " FROM tw WHERE n1 > 0 AND n0 > 0"


NAMES = ["|".join(u) for u in UNITS]


def _of_unit(i: str, values: str) -> str:
    """The unit's name, and its value among x0.. (values is their pattern), by its number in column i."""
    names = " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(NAMES))
    each = " ".join(f"WHEN {k} THEN {values.format(k)}" for k in range(len(UNITS)))
    return f"CASE {i} {names} END AS u, CASE {i} {each} END AS x"


def _sums(text: str) -> str:
    return ", ".join(text.format(i=i, v=_value(u, "me.", "other.")) for i, u in enumerate(UNITS))


# The nulls as SQL over draws, trials and units: what DuckDB runs.  `nulls` has the form for Spark, where draws pick among sums.

#: Allocation number h % c of a block's c label allocations, those with early positives first, for all units alike.
LABEL_STEPS = f""", xw AS ({WIDE}
), mk AS (
  SELECT n, mask, ones, row_number() OVER (PARTITION BY n, ones ORDER BY mask DESC) - 1 AS place, count(*) OVER (PARTITION BY n, ones) AS c
  FROM (SELECT a.r + 1 AS n, m.r AS mask, bit_count(m.r) AS ones FROM SERIES(10) a JOIN SERIES(1024) m ON m.r < (1 << (a.r + 1)::INT)) q
), {draws.stream_sql("(SELECT DISTINCT g, b, n1, n0 FROM xw) blk", SEEDS["label"], ["g", "b"], ["n1", "n0"], LABELS)}, pk AS (
  SELECT hs.r, xw.*, CASE WHEN (mask >> (hs.n1 + hs.n0 - 1 - (t - 10 * xw.b))::INT) & 1 = 1 THEN xw.n0 ELSE -xw.n1 END * 1e0 / (xw.n1 + xw.n0) AS c
  FROM hs JOIN mk ON mk.n = hs.n1 + hs.n0 AND mk.ones = hs.n1 AND mk.place = h % mk.c JOIN xw ON xw.g = hs.g AND xw.b = hs.b
), nw AS (SELECT r, {", ".join(f"sum(x{i} * c) / sum(wn) AS x{i}" for i in range(6))} FROM pk GROUP BY r
), nu AS (SELECT nw.r, {_of_unit("i.r", "x{}")[:-5]} AS e FROM nw CROSS JOIN SERIES(6) i
)"""

#: Each trial takes one pair of its group's three, the observed one included; every unit draws for itself.
DYAD_STEPS = f""", xw AS ({WIDE}
), {draws.stream_sql("xw", SEEDS["dyad"], ["g", "t"], ["kw"] + [f"x{i}" for i in range(6)], DYADS, 6)}, pd AS (
  SELECT r, ui, kw, CASE WHEN h % 3 = 0 THEN x0 WHEN h % 3 = 1 THEN x1 ELSE x2 END AS c, CASE WHEN h % 3 = 0 THEN x3 WHEN h % 3 = 1 THEN x4 ELSE x5 END AS q FROM hs
), nw AS (SELECT r, ui, sum(kw * CASE WHEN ui < 3 THEN c ELSE q END) AS x FROM pd GROUP BY r, ui
), nu AS (SELECT r, {_of_unit("ui", "x")[:-5]} / w_all AS e FROM nw CROSS JOIN tot
)"""

#: Partners of other groups at the same trial; labels stay with the first.  Every unit has derangements of its own.
PARTNER_STEPS = ", " + derange.derangements_sql("tt", PARTNERS, SEEDS["partner"], 6) + f""", hs AS (
  SELECT hp.g, hp.h, {_sums("sum(k * ({v})) AS x{i}")}
  FROM (SELECT DISTINCT g, h FROM de) hp JOIN co me ON me.g = hp.g JOIN tt other ON other.g = hp.h AND other.t = me.t
  GROUP BY hp.g, hp.h
), nw AS (SELECT de.r AS r, de.f AS f, {", ".join(f"sum(x{i}) AS x{i}" for i in range(6))} FROM de JOIN hs ON hs.g = de.g AND hs.h = de.h GROUP BY de.r, de.f
), nu AS (SELECT r, {_of_unit("f", "x{}")[:-5]} AS e FROM nw
)"""

#: Trials of a pair's second participant move by a lag of at least two within the block; every unit draws for itself.
TIME_STEPS = f""", bl AS (
  SELECT me.g, me.b, l.r AS l, {_sums("sum(me.kw * ({v})) AS x{i}")}
  FROM (SELECT tw.*, min(t) OVER (PARTITION BY g, b) AS t0 FROM tw WHERE n1 > 0 AND n0 > 0) me JOIN SERIES(10) l ON least(l.r, n1 + n0 - l.r) >= 2
  JOIN tt other ON other.g = me.g AND other.b = me.b AND other.t = t0 + (me.t - t0 + l.r) % (n1 + n0)
  GROUP BY me.g, me.b, l.r
), {draws.stream_sql("(SELECT g, b, n1 + n0 AS n FROM bw WHERE n1 > 0 AND n0 > 0 AND n1 + n0 >= 4) blk", SEEDS["time"], ["g", "b"], ["n"], SHIFTS, 6)}, nu AS (
  SELECT r, u, sum(x) / max(w_all) AS e FROM (SELECT r, {_of_unit("ui", "x{}")} FROM hs JOIN bl ON bl.g = hs.g AND bl.b = hs.b AND bl.l = 2 + h % (n - 3)) q CROSS JOIN tot GROUP BY r, u
)"""
STEPS = {"label": LABEL_STEPS, "time": TIME_STEPS, "partner": PARTNER_STEPS, "dyad": DYAD_STEPS}

#: Studentized max-statistic: z uses the null's mean and sd; a unit without spread has p = 1.  The null is read once.
MAXT = """, st AS (
  SELECT r, nu.u, e, effect, avg(e) OVER (PARTITION BY nu.u) AS m, stddev_samp(e) OVER (PARTITION BY nu.u) AS s, count(*) OVER (PARTITION BY nu.u) AS draws
  FROM nu JOIN ob ON ob.u = nu.u
), nz AS (
  SELECT r, u, effect, m, s, draws, CASE WHEN s > 1e-12 THEN round(abs((e - m) / s), 9) END AS z, CASE WHEN s > 1e-12 THEN round((effect - m) / s, 9) END AS own FROM st
), mx AS (SELECT nz.*, max(z) OVER (PARTITION BY r) AS top FROM nz
), mt AS (
  SELECT u, max(effect) AS effect, max(m) AS m, max(s) AS s, max(own) AS z, max(draws) AS draws,
    CASE WHEN max(own) IS NULL THEN 1e0 ELSE (1 + sum(CASE WHEN z >= abs(own) THEN 1 ELSE 0 END)) * 1e0 / (max(draws) + 1) END AS p_raw,
    CASE WHEN max(own) IS NULL THEN 1e0 ELSE (1 + sum(CASE WHEN top >= abs(own) THEN 1 ELSE 0 END)) * 1e0 / (max(draws) + 1) END AS p_max
  FROM mx GROUP BY u
)"""
SHOW_MAXT = "SELECT u AS unit, round(effect, 6) AS effect, round(m, 6) AS null_mean, round(s, 6) AS null_sd, round(z, 5) AS z, round(p_raw, 6) AS p_unadjusted, round(p_max, 6) AS p_maxt, p_max < 0.05 AS candidate FROM mt"
SHOW_NULL = "SELECT u AS unit, CAST(r AS BIGINT) AS realization, round(e, 6) AS null_effect FROM nu"

SUMMARY = """SELECT nu.u AS unit, count(*) AS draws, round(avg(e), 6) AS null_mean, round(stddev_samp(e), 6) AS null_sd,
  round(PCT(abs(e - m), 0.95), 6) AS q95_dev, round(PCT(abs(e - m), 0.99), 6) AS q99_dev, round(max(abs(e - m)), 6) AS max_dev,
  round(max(abs(effect - m)), 6) AS observed_dev, CAST(sum(CASE WHEN round(abs(e - m), 9) >= round(abs(effect - m), 9) THEN 1 ELSE 0 END) AS BIGINT) AS exceed,
  round((1 + sum(CASE WHEN round(abs(e - m), 9) >= round(abs(effect - m), 9) THEN 1 ELSE 0 END)) * 1e0 / (count(*) + 1), 6) AS p_two_sided
FROM nu JOIN (SELECT u, avg(e) AS m FROM nu GROUP BY u) c ON c.u = nu.u JOIN ob ON ob.u = nu.u GROUP BY nu.u"""

#: A unit's totals come from a sum by unit and are joined to its groups, so no task holds all groups of a unit.
LOTO = """, ta AS (SELECT u, sum(effect * w) AS sw, sum(w) AS ws, sum(effect) AS se, count(*) AS n FROM ge GROUP BY u
), al AS (SELECT ge.u, g, effect, w, sw, ws, se, n FROM ge JOIN ta ON ta.u = ge.u
), lo AS (SELECT u, g, effect, w, sw / ws AS full_effect, (sw - w * effect) / (ws - w) AS loto, (se - effect) / (n - 1) AS equal_loto, se / n AS equal_full, w / ws AS share FROM al WHERE ws > w
)"""

#: Resamples of the cluster bootstrap; each slot takes any of the n groups by an integer of its own hash.
RESAMPLES = 10_000

BOOT_SEED = 990200
BOOT_STEPS = f""", gn AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM ge) q
), {draws.stream_sql("gn", BOOT_SEED, ["i"], ["n"], RESAMPLES)}, bs AS (SELECT hs.r, ge.u, sum(effect * w) / sum(w) AS e FROM hs JOIN gn ON gn.i = h % hs.n JOIN ge ON ge.g = gn.g GROUP BY hs.r, ge.u
)"""


#: Balance of a group's classes by task: the masks of the two tasks keep trials whose values stay under their bounds.
_TASKS = {"decision": 150, "feedback": 100}
BALANCE_BY_TASK = "SELECT g, " + ", ".join(
    f"n1_{k} AS {k}_retained_ccc, n0_{k} AS {k}_retained_other, least(n1_{k}, n0_{k}) AS {k}_minority, CASE WHEN least(n1_{k}, n0_{k}) > 0 THEN round(greatest(n1_{k}, n0_{k}) * 1e0 / least(n1_{k}, n0_{k}), 6) END AS {k}_imbalance, "
    f"CASE WHEN n1_{k} + n0_{k} > 0 THEN round(n1_{k} * n0_{k} * 1e0 / (n1_{k} + n0_{k}), 6) ELSE 0e0 END AS {k}_weight, CASE WHEN n1_{k} + n0_{k} > 0 THEN round(n1_{k} * n0_{k} * 4e0 / (n1_{k} + n0_{k}) / n, 6) ELSE 0e0 END AS {k}_versus_even" for k in _TASKS
) + " FROM (SELECT g, count(*) AS n, " + ", ".join(
    f"CAST(sum(CASE WHEN greatest(v0, v1, v2) <= {most} THEN y ELSE 0 END) AS BIGINT) AS n1_{k}, CAST(sum(CASE WHEN greatest(v0, v1, v2) <= {most} THEN 1 - y ELSE 0 END) AS BIGINT) AS n0_{k}" for k, most in _TASKS.items()
) + " FROM tt GROUP BY g) q"


def direction(x: str) -> str:
    """The label of an effect's direction; effects within 1e-12 of zero have none."""
    return f"CASE WHEN {x} > 1e-12 THEN 'CCC>Other' WHEN {x} < -1e-12 THEN 'CCC<Other' ELSE 'zero' END"


#: Four estimators of each unit (by block, by group, by group alike, without flagged trials), their directions, leave-one-out, the largest group, and the blocks that agree.
CANDIDATES = f"""SELECT p.u AS unit, {direction("p.effect")} AS direction, round(p.effect, 6) AS primary_effect, round(s.triad, 6) AS triad_effect, round(s.equal, 6) AS equal_effect, round(m.effect, 6) AS masked_effect,
  {direction("s.triad")} = {direction("p.effect")} AS triad_agrees, {direction("s.equal")} = {direction("p.effect")} AS equal_agrees, {direction("m.effect")} = {direction("p.effect")} AS masked_agrees,
  {direction("s.triad")} = {direction("p.effect")} AND {direction("s.equal")} = {direction("p.effect")} AND {direction("m.effect")} = {direction("p.effect")} AS all_agree,
  abs(p.effect - l.full_effect) < 1e-9 AS recombines, round(l.low, 6) AS loto_min, round(l.high, 6) AS loto_max, round(l.same, 6) AS loto_consistency, d.g AS dominant, round(d.share, 6) AS dominant_share,
  k.n_blocks AS informative_blocks, k.n_same AS blocks_same, round(k.n_same * 1e0 / k.n_blocks, 6) AS block_consistency, round(k.w_same, 6) AS block_weight_same
FROM ob p JOIN (
  SELECT u, sum(e * w) / sum(w) AS triad, avg(e) AS equal FROM (SELECT ux.u, ux.g, avg(CASE WHEN y = 1 THEN x END) - avg(CASE WHEN y = 0 THEN x END) AS e, max(gi.w) AS w FROM ux JOIN gi ON gi.g = ux.g GROUP BY ux.u, ux.g) q GROUP BY u
) s ON s.u = p.u LEFT JOIN (
  SELECT u, sum(e * w) / sum(w) AS effect FROM (SELECT u, g, b, avg(CASE WHEN y = 1 THEN x END) - avg(CASE WHEN y = 0 THEN x END) AS e, sum(y) * (count(*) - sum(y)) * 1e0 / count(*) AS w
    FROM (SELECT ux.* FROM ux LEFT JOIN (SELECT DISTINCT g, t FROM tr WHERE v > 150) f ON f.g = ux.g AND f.t = ux.t WHERE f.g IS NULL) o GROUP BY u, g, b HAVING sum(y) > 0 AND sum(y) < count(*)) q GROUP BY u
) m ON m.u = p.u JOIN (
  SELECT u, max(full_effect) AS full_effect, min(loto) AS low, max(loto) AS high, avg(CASE WHEN {direction("loto")} = {direction("full_effect")} THEN 1e0 ELSE 0e0 END) AS same FROM lo GROUP BY u
) l ON l.u = p.u JOIN (
  SELECT u, g, share FROM (SELECT al.u, g, abs(effect * w) / sa AS share, row_number() OVER (PARTITION BY al.u ORDER BY round(abs(effect * w), 9) DESC, g) AS place FROM al JOIN (SELECT u, sum(abs(effect * w)) AS sa FROM al GROUP BY u) t ON t.u = al.u) q WHERE place = 1
) d ON d.u = p.u JOIN (
  SELECT be.u, count(*) AS n_blocks, CAST(sum(CASE WHEN {direction("e")} = {direction("ob.effect")} THEN 1 ELSE 0 END) AS BIGINT) AS n_same, sum(CASE WHEN {direction("e")} = {direction("ob.effect")} THEN w ELSE 0 END) / sum(w) AS w_same FROM be JOIN ob ON ob.u = be.u GROUP BY be.u
) k ON k.u = p.u"""


#: The older bootstrap, of group effects without weights: each unit's groups are a population of their own.
UNWEIGHTED_SEED = 990100
UNWEIGHTED = f""", up AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS pop, n, m FROM (SELECT u, count(*) AS n, avg(effect) AS m FROM ge GROUP BY u) q
), ui AS (SELECT up.pop, up.n, effect AS x, row_number() OVER (PARTITION BY up.pop ORDER BY g) - 1 AS i FROM ge JOIN up ON up.u = ge.u
)"""


def _queries() -> dict:
    """A text, (more steps, text), or (null, more steps, text) where nu (r, u, e) is the null's realizations."""
    return {
        "labels_ccc": "SELECT g, t, b, y AS label FROM tt",
        "block_weights": "SELECT g, b, n1, n0, round(w, 6) AS w FROM w",
        "block_balance": "SELECT g, b, n1 AS ccc, n0 AS other, least(n1, n0) AS minority, round(n1 * n0 * 1e0 / (n1 + n0), 6) AS information_weight, n1 > 0 AND n0 > 0 AS informative FROM bw",
        "block_triad_ratio": "SELECT bl.g, round(bl.w, 6) AS block_information, round(gi.w, 6) AS triad_information, round(bl.w / gi.w, 6) AS ratio FROM (SELECT g, sum(w) AS w FROM w GROUP BY g) bl JOIN gi ON gi.g = bl.g",
        "class_balance": "SELECT g, n1, n0, least(n1, n0) AS minority, CASE WHEN least(n1, n0) > 0 THEN round(greatest(n1, n0) * 1e0 / least(n1, n0), 6) END AS imbalance, round(n1 * n0 * 4e0 / (n1 + n0) / (n1 + n0), 6) AS versus_even FROM gw",
        "balance_thresholds": "SELECT k.most, count(g) AS n_groups, coalesce(TEXTS(g), '') AS ids FROM (SELECT CASE r WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 5 ELSE 10 END AS most FROM SERIES(5) s) k LEFT JOIN gw ON least(n1, n0) <= k.most GROUP BY k.most",
        "class_balance_by_task": BALANCE_BY_TASK,
        "effect_reconciliation": "SELECT ob.u AS unit, round(effect, 6) AS effect, round(again, 6) AS recombined, abs(effect - again) <= 1e-7 + 1e-5 * abs(again) AS reconciled FROM ob JOIN (SELECT u, sum(effect * w) / sum(w) AS again FROM ge GROUP BY u) r ON r.u = ob.u",
        "candidate_audit_full": (LOTO, CANDIDATES),
        "flagged_balance": "SELECT tt.g, count(*) AS n_flagged, CAST(sum(y) AS BIGINT) AS ccc, CAST(count(*) - sum(y) AS BIGINT) AS other, round(avg(y * 1e0), 6) AS ccc_share FROM tt WHERE greatest(v0, v1, v2) > 150 GROUP BY tt.g",
        "coeff_block": "SELECT g, t, round(k, 9) AS coeff FROM co",
        "coeff_triad": "SELECT tt.g, tt.t, round(gi.w / (SELECT sum(w) FROM gi) * CASE WHEN y = 1 THEN 1e0 / n1 ELSE -1e0 / n0 END, 9) AS coeff FROM tt JOIN gi ON gi.g = tt.g",
        "coeff_equal": "SELECT tt.g, tt.t, round(CASE WHEN y = 1 THEN 1e0 / n1 ELSE -1e0 / n0 END / (SELECT count(*) FROM gi), 9) AS coeff FROM tt JOIN gi ON gi.g = tt.g",
        "coeff_algebra_checks": "SELECT abs(sum(k)) < 1e-9 AS sums_to_zero, abs(sum(CASE WHEN k > 0 THEN k ELSE 0 END) - 1) < 1e-9 AS positive_is_one, abs(sum(CASE WHEN k < 0 THEN k ELSE 0 END) + 1) < 1e-9 AS negative_is_one, count(*) AS n FROM co",
        "observed_effects": "SELECT u AS unit, round(effect, 6) AS block_effect FROM ob",
        "secondary_effects": "SELECT u AS unit, round(sum(e * w) / sum(w), 6) AS triad_effect, round(avg(e), 6) AS equal_effect FROM (SELECT ux.u, ux.g, avg(CASE WHEN y = 1 THEN x END) - avg(CASE WHEN y = 0 THEN x END) AS e, max(gi.w) AS w FROM ux JOIN gi ON gi.g = ux.g GROUP BY ux.u, ux.g) q GROUP BY u",
        "effects_bundle": "SELECT u AS unit, round(sum(k) / sum(wn), 6) AS block_effect, round(sum(CASE WHEN n1 > 0 AND n0 > 0 THEN (s1 / n1 - s0 / n0) * n1 * n0 / (n1 + n0) END) / sum(CASE WHEN n1 > 0 AND n0 > 0 THEN n1 * n0 * 1e0 / (n1 + n0) END), 6) AS triad_effect, round(avg(CASE WHEN n1 > 0 AND n0 > 0 THEN s1 / n1 - s0 / n0 END), 6) AS equal_effect, count(*) AS n_groups FROM (SELECT u, g, sum(x * kw) AS k, sum(wn) AS wn, sum(y) * 1e0 AS n1, (count(*) - sum(y)) * 1e0 AS n0, sum(x * y) AS s1, sum(x * (1 - y)) AS s0 FROM ux GROUP BY u, g) q GROUP BY u",
        "group_block_effects": "SELECT u AS unit, g, round(effect, 6) AS effect, round(w, 6) AS weight FROM ge",
        "masked_effects": "SELECT u AS unit, round(sum(e * w) / sum(w), 6) AS effect FROM (SELECT u, g, b, avg(CASE WHEN y = 1 THEN x END) - avg(CASE WHEN y = 0 THEN x END) AS e, sum(y) * (count(*) - sum(y)) * 1e0 / count(*) AS w FROM (SELECT ux.* FROM ux LEFT JOIN (SELECT DISTINCT g, t FROM tr WHERE v > 150) f ON f.g = ux.g AND f.t = ux.t WHERE f.g IS NULL) m GROUP BY u, g, b HAVING sum(y) > 0 AND sum(y) < count(*)) q GROUP BY u",
        "label_null": ("label", "", SHOW_NULL),
        "label_null_maxt": ("label", MAXT, SHOW_MAXT),
        "pvalue_grid_checks": ("label", MAXT, "SELECT u AS unit, abs(p_max * (draws + 1) - round(p_max * (draws + 1))) < 1e-6 AS on_grid, p_max >= p_raw - 1e-12 AS monotone FROM mt"),
        "null_separation": ("label", "", SUMMARY),
        "dyad_null": ("dyad", "", SHOW_NULL),
        "dyad_null_maxt": ("dyad", MAXT, SHOW_MAXT),
        "partner_null": ("partner", "", SHOW_NULL),
        "partner_null_maxt": ("partner", MAXT, SHOW_MAXT),
        "time_shift_null": ("time", "", SHOW_NULL),
        "time_shift_maxt": ("time", MAXT, SHOW_MAXT),
        "null_correlation": ("label", "", "SELECT a.u AS unit_a, b.u AS unit_b, round(corr(a.e, b.e), 6) AS r FROM nu a JOIN nu b ON a.r = b.r AND a.u < b.u GROUP BY a.u, b.u"),
        "loto": (LOTO, "SELECT u AS unit, g AS omitted, round(full_effect, 6) AS full_effect, round(loto, 6) AS loto_effect, round(loto - full_effect, 6) AS change, sign(round(loto, 9)) = sign(round(full_effect, 9)) AND round(full_effect, 9) <> 0 AS same_direction FROM lo"),
        "loto_influence": (LOTO, "SELECT unit, omitted, change FROM (SELECT u AS unit, g AS omitted, round(loto - full_effect, 6) AS change, row_number() OVER (PARTITION BY u ORDER BY round(abs(loto - full_effect), 9) DESC, g) AS k FROM lo) q WHERE k = 1"),
        "dominant_group": (LOTO, "SELECT unit, g, share FROM (SELECT u AS unit, g, round(abs(effect * w) / sum(abs(effect * w)) OVER (PARTITION BY u), 6) AS share, row_number() OVER (PARTITION BY u ORDER BY round(abs(effect * w), 9) DESC, g) AS k FROM lo) q WHERE k = 1"),
        "equal_weight_stability": (LOTO, "SELECT u AS unit, round(max(equal_full), 6) AS equal_effect, round(min(equal_loto), 6) AS loto_min, round(max(equal_loto), 6) AS loto_max, round(avg(CASE WHEN sign(round(effect, 9)) = sign(round(full_effect, 9)) THEN 1e0 ELSE 0e0 END), 6) AS same_share FROM lo GROUP BY u"),
        "candidate_audit": (LOTO, "SELECT u AS unit, count(*) AS n_groups, round(max(full_effect), 6) AS effect, round(min(loto), 6) AS loto_min, round(max(loto), 6) AS loto_max, CAST(sum(CASE WHEN round(effect, 9) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive_groups, round(sum(CASE WHEN sign(round(effect, 9)) = sign(round(full_effect, 9)) THEN share ELSE 0 END), 6) AS supporting_weight FROM lo GROUP BY u"),
        "stability_bundle": ("bootstrap", LOTO, """SELECT a.*, draws, median, low, high, boot_same, low > 0 OR high < 0 AS excludes_zero FROM (
  SELECT u AS unit, count(*) AS n_groups, round(max(full_effect), 6) AS effect, CAST(sum(CASE WHEN sign(round(effect, 9)) = sign(round(full_effect, 9)) THEN 1 ELSE 0 END) AS BIGINT) AS same_groups,
    CAST(sum(CASE WHEN round(effect, 9) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive_groups, round(sum(CASE WHEN sign(round(effect, 9)) = sign(round(full_effect, 9)) THEN share ELSE 0 END), 6) AS same_weight,
    CAST(sum(CASE WHEN sign(round(loto, 9)) = sign(round(full_effect, 9)) THEN 1 ELSE 0 END) AS BIGINT) AS loto_same, round(min(loto), 6) AS loto_min, round(max(loto), 6) AS loto_max,
    min(CASE WHEN k = 1 THEN g END) AS most_influential, round(max(abs(loto - full_effect)), 6) AS largest_change, round(max(share), 6) AS largest_share,
    round(max(equal_full), 6) AS equal_effect, sign(round(max(equal_full), 9)) = sign(round(max(full_effect), 9)) AS equal_agrees, round(min(equal_loto), 6) AS equal_min, round(max(equal_loto), 6) AS equal_max
  FROM (SELECT lo.*, row_number() OVER (PARTITION BY u ORDER BY round(abs(loto - full_effect), 9) DESC, g) AS k FROM lo) lo GROUP BY u) a JOIN (
  SELECT bs.u, count(*) AS draws, round(PCT(e, 0.5), 6) AS median, round(PCT(e, 0.025), 6) AS low, round(PCT(e, 0.975), 6) AS high, round(avg(CASE WHEN sign(round(e, 9)) = sign(round(effect, 9)) THEN 1e0 ELSE 0e0 END), 6) AS boot_same
  FROM bs JOIN ob ON ob.u = bs.u GROUP BY bs.u) b ON b.u = a.unit"""),
        "cluster_bootstrap": ("bootstrap", "", "SELECT bs.u AS unit, count(*) AS draws, round(PCT(e, 0.5), 6) AS median, round(PCT(e, 0.025), 6) AS low, round(PCT(e, 0.975), 6) AS high, round(avg(CASE WHEN sign(round(e, 9)) = sign(round(effect, 9)) THEN 1e0 ELSE 0e0 END), 6) AS same_direction FROM bs JOIN ob ON ob.u = bs.u GROUP BY bs.u"),
        "rank_stability": (LOTO, "SELECT a.u AS unit_a, b.u AS unit_b, round(corr(a.k, b.k), 6) AS rank_correlation FROM (SELECT u, g, CAST(row_number() OVER (PARTITION BY u ORDER BY round(effect, 9), g) AS DOUBLE) AS k FROM lo) a JOIN (SELECT u, g, CAST(row_number() OVER (PARTITION BY u ORDER BY round(effect, 9), g) AS DOUBLE) AS k FROM lo) b ON a.g = b.g AND a.u < b.u GROUP BY a.u, b.u"),
        "direction_agreement": "SELECT a.d AS dyad, round(a.effect, 6) AS closeness, round(b.effect, 6) AS ratio, sign(round(a.effect, 9)) = sign(round(b.effect, 9)) AS agrees FROM (SELECT split_part(u, '|', 1) AS d, effect FROM ob WHERE u LIKE '%closeness') a JOIN (SELECT split_part(u, '|', 1) AS d, effect FROM ob WHERE u LIKE '%ratio') b ON a.d = b.d",
        "cube_descriptives": "SELECT a.*, round(median_sd, 6) AS median_group_sd, round(min_sd, 6) AS min_group_sd FROM (SELECT u AS unit, count(*) AS n, round(min(x), 6) AS low, round(PCT(x, 0.01), 6) AS p01, round(PCT(x, 0.5), 6) AS median, round(avg(x), 6) AS mean, round(PCT(x, 0.99), 6) AS p99, round(max(x), 6) AS high, round(stddev_pop(x), 6) AS sd, round(avg(CASE WHEN x >= 0.95 THEN 1e0 ELSE 0e0 END), 6) AS near_one FROM ux GROUP BY u) a JOIN (SELECT u, PCT(sd, 0.5) AS median_sd, min(sd) AS min_sd FROM (SELECT u, g, stddev_pop(x) AS sd FROM ux GROUP BY u, g) q GROUP BY u) b ON b.u = a.unit",
        "cube_audit": "SELECT count(*) AS n, count(DISTINCT u) AS n_units, count(DISTINCT g) AS n_groups, count(*) = count(x) AS finite, bool_and(x >= 0) AS not_below, bool_and(x <= 1) AS not_above, count(*) = count(DISTINCT concat(g, '|', t, '|', u)) AS unique_keys, count(*) = 6 * count(DISTINCT concat(g, '|', t)) AS all_units_in_trials, stddev_pop(x) > 0 AS varies, min(sd) > 0 AS every_unit_varies, bool_and(y IN (0, 1)) AS labels_binary, bool_and(n1 + n0 <= 10) AS blocks_bounded, min(t) = 0 AS starts_at_0, bool_and(abs(wn * (n1 + n0) * (n1 + n0) - n1 * n0) < 1e-9) AS weights_match FROM (SELECT ux.*, stddev_pop(x) OVER (PARTITION BY u) AS sd FROM ux) q",
        "mask_counts": "SELECT tt.g, count(*) AS n_total, CAST(sum(m) AS BIGINT) AS n_excluded, CAST(sum(y) AS BIGINT) AS ccc_total, CAST(sum(y * (1 - m)) AS BIGINT) AS ccc_retained, CAST(sum((1 - y) * (1 - m)) AS BIGINT) AS other_retained, sum(y * (1 - m)) > 0 AND sum((1 - y) * (1 - m)) > 0 AS both_classes FROM (SELECT tt.*, CASE WHEN greatest(v0, v1, v2) > 150 THEN 1 ELSE 0 END AS m FROM tt) tt GROUP BY tt.g",
        "key_integrity": "SELECT 'turns' AS keys, CAST(conv_id AS BIGINT) AS owner, count(*) AS n, count(*) = count(DISTINCT turn) AS no_duplicates, min(turn) = 0 AND max(turn) + 1 = count(DISTINCT turn) AS complete, count(DISTINCT concat(turn, '|', role)) = count(DISTINCT turn) AS no_conflict FROM {conversations} GROUP BY conv_id UNION ALL SELECT 'times', CAST(user_id AS BIGINT), count(*), count(*) = count(DISTINCT ts), count(ts) = count(*), count(DISTINCT concat(CAST(ts AS STRING), '|', event_type)) = count(DISTINCT ts) FROM {events} GROUP BY user_id",
        "block_allocations": "SELECT g, b, n1, n0, CAST(round(factorial(CAST(n1 + n0 AS INT)) * 1e0 / (factorial(CAST(n1 AS INT)) * 1e0 * factorial(CAST(n0 AS INT))), 0) AS BIGINT) AS allocations FROM bw",
        "balanced_labels": "SELECT tt.g, tt.t, CASE WHEN k <= floor(n / 2) THEN 1 ELSE 0 END AS label FROM tt JOIN (SELECT t, row_number() OVER (PARTITION BY b ORDER BY md5(concat('53|', t)), t) AS k, count(*) OVER (PARTITION BY b) AS n FROM (SELECT DISTINCT t, b FROM tt) a) q ON q.t = tt.t",
        "flag_sources": "SELECT g, t, count(*) AS n, TEXTS(p) AS participants FROM tr WHERE v > 150 GROUP BY g, t",
        "pvalue_matrix": ("label", MAXT, "SELECT split_part(u, '|', 1) AS dyad, round(max(CASE WHEN u LIKE '%closeness' THEN p_max END), 6) AS closeness, round(max(CASE WHEN u LIKE '%ratio' THEN p_max END), 6) AS ratio, round(max(-log10(greatest(p_max, 1e-12))), 6) AS strongest FROM mt GROUP BY split_part(u, '|', 1)"),
    }


def texts() -> dict[str, str]:
    """Queries without a null: one text for both engines."""
    own = {name: x if isinstance(x, tuple) else ("", x) for name, x in _queries().items()}
    return {name: "WITH" + BASE + x[0] + "\n" + x[1] for name, x in own.items() if len(x) == 2}


def null_texts(steps: dict[str, str]) -> dict[str, str]:
    """Queries of a null, whose steps are given by its name."""
    return {name: "WITH" + BASE + steps[x[0]] + x[1] + "\n" + x[2] for name, x in _queries().items() if isinstance(x, tuple) and x[0] in steps}


def boot_texts(steps: str) -> dict[str, str]:
    """Queries of the bootstrap, whose steps lead to bs (r, u, e)."""
    return {name: "WITH" + BASE + x[1] + steps + "\n" + x[2] for name, x in _queries().items() if isinstance(x, tuple) and x[0] == "bootstrap"}
