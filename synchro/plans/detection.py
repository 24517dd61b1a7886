"""Detection by stage: runs, cells and the stress summary.

A run is a supplier's items of one return flag (scenario) and line status (cell); its units are the line numbers, of which the first two
are true in all scenarios but A, the null scenario.  A unit passes the naive stage by its largest discount, the
label stage if its largest tax passes too, and the full stage if its largest quantity does as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap
from ..operators.draws import stream_sql
from ..operators.ranks import numbered
from ..sources.scratch import saved
from . import dialect

Z = "1.959963984540054e0"


def wilson(k: str, n: str, name: str) -> str:
    """Rate and Wilson interval of k among n as columns."""
    rate, square = f"{k} * 1e0 / {n}", f"{Z} * {Z}"
    mid = f"({rate} + {square} / (2e0 * {n})) / (1 + {square} / {n})"
    half = f"{Z} / (1 + {square} / {n}) * sqrt({rate} * (1 - {rate}) / {n} + {square} / (4e0 * {n} * {n}))"
    return f"round({rate}, 6) AS {name}_rate, round(greatest({mid} - {half}, 0e0), 6) AS {name}_low, round(least({mid} + {half}, 1e0), 6) AS {name}_high"


UNITS = """
un AS (
  SELECT l_returnflag AS scenario, l_linestatus AS cell, l_suppkey AS rep, l_linenumber AS unit, max(l_discount) >= 0.1 AS naive, max(l_tax) >= 0.08 AS more, max(l_quantity) >= 49 AS most
  FROM {lineitem} GROUP BY l_returnflag, l_linestatus, l_suppkey, l_linenumber
), st AS (
  SELECT scenario, cell, rep, CASE WHEN r = 0 THEN 'naive' WHEN r = 1 THEN 'label' ELSE 'full' END AS stage,
    CASE WHEN unit <= 2 AND scenario <> 'A' THEN 1 ELSE 0 END AS y, CASE WHEN naive AND (r = 0 OR more) AND (r < 2 OR most) THEN 1 ELSE 0 END AS hit
  FROM un CROSS JOIN SERIES(3) s
), ru AS (
  SELECT scenario, cell, rep, stage, CAST(sum(y) AS BIGINT) AS n_true, CAST(sum(hit * y) AS BIGINT) AS tp, CAST(sum(hit * (1 - y)) AS BIGINT) AS fp,
    CAST(sum((1 - hit) * y) AS BIGINT) AS fn, CAST(sum((1 - hit) * (1 - y)) AS BIGINT) AS tn
  FROM st GROUP BY scenario, cell, rep, stage
), me AS (
  SELECT ru.*, tp * 1e0 / nullif(tp + fn, 0) AS sensitivity, tp * 1e0 / nullif(tp + fp, 0) AS precision_, fp * 1e0 / nullif(fp + tn, 0) AS fpr, 2e0 * tp / nullif(2 * tp + fp + fn, 0) AS f1,
    tp + fp > 0 AS any_detection, n_true > 0 AND fn = 0 AS all_true, fp = 0 AS zero_fp, n_true > 0 AND fn = 0 AND fp = 0 AS exact_recovery
  FROM ru
), ce AS (
  SELECT scenario, cell, stage, count(*) AS n, max(n_true) AS n_true, CAST(sum(CASE WHEN any_detection THEN 1 ELSE 0 END) AS BIGINT) AS k_any, CAST(sum(CASE WHEN all_true THEN 1 ELSE 0 END) AS BIGINT) AS k_all,
    CAST(sum(CASE WHEN zero_fp THEN 1 ELSE 0 END) AS BIGINT) AS k_zero, CAST(sum(CASE WHEN exact_recovery THEN 1 ELSE 0 END) AS BIGINT) AS k_exact,
    avg(sensitivity) AS sensitivity, avg(precision_) AS precision_, avg(fpr) AS fpr, avg(f1) AS f1, avg(tp + fp) AS detected
  FROM me GROUP BY scenario, cell, stage
)"""


def texts() -> dict[str, str]:
    means = ", ".join(f"round({x}, 6) AS mean_{x}" for x in ("sensitivity", "precision_", "fpr", "f1", "detected"))
    rates = ", ".join(wilson(f"k_{x}", "n", x) for x in ("any", "all", "zero", "exact"))
    both = ", ".join(
        f"round(max(CASE WHEN stage = '{stage}' AND {when} THEN {x} END), 6) AS {name}_{out}"
        for name, stage in (("current", "label"), ("augmented", "full"))
        for out, x, when in (("fwer", "k_any * 1e0 / n", "n_true = 0"), ("sensitivity", "sensitivity", "n_true > 0"), ("precision", "precision_", "n_true > 0"))
    )
    q = {
        "detection_runs": "SELECT scenario, cell, rep, stage, n_true, tp, fp, fn, tn, round(sensitivity, 6) AS sensitivity, round(precision_, 6) AS precision_, round(fpr, 6) AS fpr, round(f1, 6) AS f1, any_detection, all_true, zero_fp, exact_recovery FROM me",
        "cell_summary": f"SELECT scenario, cell, stage, n, n_true, {means}, {rates}, CASE WHEN n_true = 0 THEN round(k_any * 1e0 / n, 6) END AS fwer FROM ce",
        "stress_summary": f"SELECT scenario, cell, max(n) AS n, max(n_true) AS n_true, {both} FROM ce GROUP BY scenario, cell",
    }
    return {k: "WITH" + UNITS + "\n" + v for k, v in q.items()} | score_texts()


#: Scores of a run: average precision and recall among as many as are true, by the largest discount, and average precision by the largest tax.
SCORES = """
sx AS (
  SELECT l_returnflag AS scenario, l_linestatus AS cell, l_suppkey AS rep, l_linenumber AS unit, CASE WHEN l_linenumber <= 2 AND l_returnflag <> 'A' THEN 1 ELSE 0 END AS y, max(l_discount) AS raw, max(l_tax) AS label
  FROM {lineitem} GROUP BY l_returnflag, l_linestatus, l_suppkey, l_linenumber
), nt AS (SELECT scenario, cell, rep, CAST(sum(y) AS BIGINT) AS n_true FROM sx GROUP BY scenario, cell, rep
), ts AS (
  SELECT scenario, cell, rep, kind, s, sum(y) AS d, count(*) AS c FROM (SELECT scenario, cell, rep, y, 'raw' AS kind, raw AS s FROM sx UNION ALL SELECT scenario, cell, rep, y, 'label' AS kind, label AS s FROM sx) q GROUP BY scenario, cell, rep, kind, s
), ap AS (
  SELECT scenario, cell, rep, kind, sum(d * tp * 1e0 / n) / nullif(sum(d), 0) AS ap FROM (
    SELECT scenario, cell, rep, kind, d, sum(d) OVER (PARTITION BY scenario, cell, rep, kind ORDER BY s DESC) AS tp, sum(c) OVER (PARTITION BY scenario, cell, rep, kind ORDER BY s DESC) AS n FROM ts
  ) q GROUP BY scenario, cell, rep, kind
), tk AS (
  SELECT scenario, cell, rep, sum(CASE WHEN k <= n_true THEN y ELSE 0 END) * 1e0 / nullif(max(n_true), 0) AS recall FROM (
    SELECT sx.scenario, sx.cell, sx.rep, y, n_true, row_number() OVER (PARTITION BY sx.scenario, sx.cell, sx.rep ORDER BY raw DESC, unit DESC) AS k FROM sx JOIN nt ON nt.scenario = sx.scenario AND nt.cell = sx.cell AND nt.rep = sx.rep
  ) q GROUP BY scenario, cell, rep
), rs AS (
  SELECT nt.scenario, nt.cell, nt.rep, n_true, max(CASE WHEN kind = 'raw' THEN ap END) AS raw_auprc, max(CASE WHEN kind = 'label' THEN ap END) AS label_auprc, max(recall) AS topk_recall
  FROM nt JOIN ap ON ap.scenario = nt.scenario AND ap.cell = nt.cell AND ap.rep = nt.rep JOIN tk ON tk.scenario = nt.scenario AND tk.cell = nt.cell AND tk.rep = nt.rep GROUP BY nt.scenario, nt.cell, nt.rep, n_true
)"""

#: Every measure of every run that is defined, as rows: a cell's means are taken over these.
FIELDS = ("sensitivity", "precision_", "fpr", "f1", "detected")
TALL = "fx AS (" + " UNION ALL ".join(
    [f"SELECT scenario, cell, rep, stage, '{x}' AS field, CAST({'tp + fp' if x == 'detected' else x} AS DOUBLE) AS x FROM me" for x in FIELDS]
    + [f"SELECT scenario, cell, rep, 'score' AS stage, '{x}' AS field, {x} AS x FROM rs" for x in ("raw_auprc", "label_auprc", "topk_recall")]
) + """
), fp AS (SELECT scenario, cell, stage, field, row_number() OVER (ORDER BY scenario, cell, stage, field) - 1 AS pop, n, m FROM (SELECT scenario, cell, stage, field, count(*) AS n, avg(x) AS m FROM fx WHERE x IS NOT NULL GROUP BY scenario, cell, stage, field) q
)"""
RESAMPLES, SEED = 1_000, 990000


def score_texts() -> dict[str, str]:
    return {"detection_scores": "WITH" + SCORES + "\nSELECT scenario, cell, rep, n_true, round(raw_auprc, 6) AS raw_auprc, round(label_auprc, 6) AS label_auprc, round(topk_recall, 6) AS topk_recall FROM rs"}


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of each cell's runs with bootstrap bounds, resampled by counts over the runs for which a measure is defined."""
    # items are read twice, by runs and by scores, whatever the number of measures
    items = saved(dialect.run(spark, sf_dir, "WITH" + SCORES[: SCORES.index(", nt AS (")] + " SELECT * FROM sx"), "items")
    runs = saved(dialect.run(spark, sf_dir, "WITH" + UNITS + " SELECT * FROM me"), "runs")
    scores = saved(dialect.run(spark, sf_dir, "WITH sx AS (SELECT * FROM {items})" + SCORES[SCORES.index(", nt AS (") :] + " SELECT * FROM rs", items=items), "scores")
    steps = "WITH me AS (SELECT * FROM {runs}), rs AS (SELECT * FROM {scores}), " + TALL
    pops = saved(dialect.run(spark, sf_dir, steps + " SELECT * FROM fp", runs=runs, scores=scores), "populations")
    rows = dialect.run(spark, sf_dir, steps + " SELECT scenario, cell, stage, field, rep, x FROM fx WHERE x IS NOT NULL", runs=runs, scores=scores)
    rows = numbered(rows.join(F.broadcast(pops), ["scenario", "cell", "stage", "field"]).select("pop", "rep", "n", "x"), [F.col("rep")], "i", ["pop"])
    draws = bootstrap.means(rows, RESAMPLES, SEED).groupBy("pop").agg(*(F.round(F.percentile("m", q), 6).alias(c) for c, q in (("low", 0.025), ("high", 0.975))))
    return pops.join(draws, "pop").select("scenario", "cell", "stage", "field", "n", F.round("m", 6).alias("mean"), "low", "high")


def frames() -> dict:
    return {"cell_mean_bounds": _bounds}


def oracles() -> dict[str, str]:
    text = "WITH" + UNITS + "," + SCORES + ", " + TALL + f""", fi AS (
  SELECT fp.pop, fp.n, fx.x, row_number() OVER (PARTITION BY fp.pop ORDER BY rep) - 1 AS i FROM fx JOIN fp ON fp.scenario = fx.scenario AND fp.cell = fx.cell AND fp.stage = fx.stage AND fp.field = fx.field WHERE x IS NOT NULL
), {stream_sql("fi", SEED, ["pop", "i"], ["n"], RESAMPLES)}, bm AS (SELECT hs.r, hs.pop, avg(fi.x) AS m FROM hs JOIN fi ON fi.pop = hs.pop AND fi.i = h % hs.n GROUP BY hs.r, hs.pop
), bq AS (SELECT pop, PCT(m, 0.025) AS low, PCT(m, 0.975) AS high FROM bm GROUP BY pop)
SELECT scenario, cell, stage, field, n, round(fp.m, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM fp JOIN bq ON bq.pop = fp.pop"""
    return {"cell_mean_bounds": dialect.duckdb_text(text)}
