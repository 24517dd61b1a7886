"""Quality control, masks, detection scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap
from ..operators.draws import stream_sql
from ..operators.quantiles import quantiles
from ..operators.ranks import numbered
from ..sources.scratch import saved
from . import dialect

QC = """
qc AS (
  SELECT l_suppkey AS subject, l_returnflag AS task, l_linenumber AS channel, l_orderkey AS trial, l_extendedprice AS x FROM {lineitem}
), qs AS (SELECT subject, task, count(*) AS n, sqrt(avg(x * x)) AS rms, PCT(abs(x), 0.99) AS p99, avg(CASE WHEN abs(x) > 50000 THEN 1e0 ELSE 0e0 END) AS over50k, avg(CASE WHEN abs(x) > 90000 THEN 1e0 ELSE 0e0 END) AS over90k FROM qc GROUP BY subject, task
), lo AS (SELECT subject, task, rms, ln(greatest(rms, 1e-12)) AS l FROM qs
), md AS (SELECT subject, task, rms, l, median(l) OVER (PARTITION BY task) AS m FROM lo
), ad AS (SELECT subject, task, rms, l, m, median(abs(l - m)) OVER (PARTITION BY task) AS mad FROM md
), rz AS (SELECT subject, task, rms, CASE WHEN mad = 0 THEN 0e0 ELSE 0.6744897501960817e0 * (l - m) / mad END AS z FROM ad
), ch AS (SELECT subject, task, channel, sqrt(avg(x * x)) AS rms, sum(x * x) AS energy FROM qc GROUP BY subject, task, channel
), rk AS (SELECT subject, task, channel, rms, energy / sum(energy) OVER (PARTITION BY subject, task) AS share, row_number() OVER (PARTITION BY subject, task ORDER BY round(energy, 3) DESC, channel) AS k FROM ch
)"""

DETECT = """
sc AS (SELECT l.doc_id, quality AS y, d.n_chars AS s FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id
), th AS (SELECT PCT(s, 0.5) AS cut FROM sc
), cf AS (
  SELECT CAST(sum(CASE WHEN s >= cut AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN s >= cut AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN s < cut AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN s < cut AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM sc CROSS JOIN th
)"""

CELLS = """
ce AS (SELECT l_returnflag AS scenario, l_linestatus AS cell, l_suppkey AS rep, max(CASE WHEN l_discount >= 0.1 THEN 1 ELSE 0 END) AS detected, avg(l_quantity) AS score FROM {lineitem} GROUP BY l_returnflag, l_linestatus, l_suppkey
), cs AS (SELECT scenario, cell, count(*) AS n, CAST(sum(detected) AS BIGINT) AS k, avg(score) AS score FROM ce GROUP BY scenario, cell
), wi AS (
  SELECT scenario, cell, n, k, k * 1e0 / n AS rate, score,
    (k * 1e0 / n + 1.959963984540054e0 * 1.959963984540054e0 / (2 * n)) / (1 + 1.959963984540054e0 * 1.959963984540054e0 / n) AS mid,
    1.959963984540054e0 / (1 + 1.959963984540054e0 * 1.959963984540054e0 / n) * sqrt(k * 1e0 / n * (1 - k * 1e0 / n) / n + 1.959963984540054e0 * 1.959963984540054e0 / (4e0 * n * n)) AS half
  FROM cs
)"""

#: Resamples of each cell, which is a population of its own.
RESAMPLES, SEED = 2_000, 990000
POPULATIONS = """, fp AS (SELECT scenario, cell, n, row_number() OVER (ORDER BY scenario, cell) - 1 AS pop FROM cs
)"""


def robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, task, rms, z: medians and deviations by exact quantiles, so no task holds all subjects of a task."""
    rows = saved(dialect.run(spark, sf_dir, "WITH" + QC[: QC.index("), md AS")] + ") SELECT subject, task, rms, l FROM lo"), "levels")
    middle = quantiles(rows, ["task"], "l", {"m": 0.5})
    apart = saved(rows.join(middle, rows["task"].eqNullSafe(middle["task"])).select(rows["*"], "m"), "apart")
    spread = quantiles(apart, ["task"], F.abs(F.col("l") - F.col("m")), {"mad": 0.5})
    z = F.when(F.col("mad") == 0, 0.0).otherwise(0.6744897501960817 * (F.col("l") - F.col("m")) / F.col("mad"))
    return apart.join(spread, apart["task"].eqNullSafe(spread["task"])).select("subject", apart["task"], "rms", z.alias("z"))


def frames() -> dict:
    """Reports of robust z in the form for Spark."""
    given = QC[: QC.index("), md AS")] + "), rz AS (SELECT subject, task, rms, z FROM {robust_z}\n)" + QC[QC.index(", ch AS") :]

    def run(text: str):
        return lambda spark, sf_dir: dialect.run(spark, sf_dir, text, robust_z=robust_z(spark, sf_dir))

    def bootstrap_mean_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
        steps = "WITH" + CELLS + POPULATIONS
        pops = saved(dialect.run(spark, sf_dir, steps + " SELECT scenario, cell, n, pop FROM fp"), "cells")
        rows = dialect.run(spark, sf_dir, steps + " SELECT pop, n, rep, score AS x FROM ce JOIN fp ON fp.scenario = ce.scenario AND fp.cell = ce.cell")
        got = bootstrap.means(numbered(rows, [F.col("rep")], "i", ["pop"]), RESAMPLES, SEED).groupBy("pop").agg(F.count("*").alias("draws"), *(F.round(F.percentile("m", q), 6).alias(c) for c, q in (("low", 0.025), ("high", 0.975))))
        return pops.join(got, "pop").select("scenario", "cell", "draws", "low", "high")

    names = ("qc_robust_z", "report_order", "sensitivity_mask", "retained_by_task", "mask_sources")
    return {name: run(text.replace(QC, given)) for name, text in texts().items() if name in names} | {"bootstrap_mean_ci": bootstrap_mean_ci}


def oracles() -> dict[str, str]:
    text = "WITH" + CELLS + POPULATIONS + f""", fi AS (SELECT fp.pop, fp.n, score AS x, row_number() OVER (PARTITION BY fp.pop ORDER BY rep) - 1 AS i FROM ce JOIN fp ON fp.scenario = ce.scenario AND fp.cell = ce.cell
), {stream_sql("fi", SEED, ["pop", "i"], ["n"], RESAMPLES)}, bm AS (SELECT hs.r, hs.pop, avg(fi.x) AS m FROM hs JOIN fi ON fi.pop = hs.pop AND fi.i = h % hs.n GROUP BY hs.r, hs.pop
)
SELECT scenario, cell, count(*) AS draws, round(PCT(bm.m, 0.025), 6) AS low, round(PCT(bm.m, 0.975), 6) AS high FROM bm JOIN fp ON fp.pop = bm.pop GROUP BY scenario, cell"""
    return {"bootstrap_mean_ci": dialect.duckdb_text(text)}


def texts() -> dict[str, str]:
    q = {
        "qc_subject_task": (QC, "SELECT subject, task, n, round(rms, 4) AS rms, round(p99, 4) AS p99, round(over50k, 6) AS over50k, round(over90k, 6) AS over90k FROM qs"),
        "qc_robust_z": (QC, "SELECT subject, task, round(z, 6) AS z, round(abs(z), 9) > 3.5 AS flagged FROM rz"),
        "qc_channel_rank": (QC, "SELECT subject, task, channel, round(rms, 4) AS rms, k AS place FROM rk"),
        "qc_top_n": (QC, "SELECT subject, task, channel, k AS place FROM rk WHERE k <= 3"),
        "qc_energy_share": (QC, "SELECT subject, task, channel, round(share, 6) AS share FROM rk"),
        "qc_concentration": (QC, "SELECT c.subject, c.task, round(top3, 6) AS top3, round(trials3, 6) AS trials3, CASE WHEN round(trials3, 9) >= 0.5 THEN 'trial' WHEN round(top3, 9) >= 0.5 THEN 'channel' ELSE 'diffuse' END AS kind FROM (SELECT subject, task, sum(CASE WHEN k <= 3 THEN share ELSE 0 END) AS top3 FROM rk GROUP BY subject, task) c JOIN (SELECT subject, task, sum(CASE WHEN k <= 3 THEN e ELSE 0 END) / sum(e) AS trials3 FROM (SELECT subject, task, trial, sum(x * x) AS e, row_number() OVER (PARTITION BY subject, task ORDER BY round(sum(x * x), 3) DESC, trial) AS k FROM qc GROUP BY subject, task, trial) q GROUP BY subject, task) t ON t.subject = c.subject AND t.task = c.task"),
        "report_order": (QC, "SELECT row_number() OVER (PARTITION BY task ORDER BY round(abs(z), 9) DESC, subject) AS place, task, CASE task WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS task_order, subject, round(abs(z), 6) AS size FROM rz"),
        "qc_overlap": (QC, "SELECT a.subject, a.task AS task_a, b.task AS task_b, count(*) AS shared FROM rk a JOIN rk b ON a.subject = b.subject AND a.channel = b.channel AND a.task < b.task WHERE a.k <= 3 AND b.k <= 3 GROUP BY a.subject, a.task, b.task"),
        "sensitivity_mask": (QC, "SELECT qc.subject, qc.task, qc.trial, max(CASE WHEN rz.subject IS NOT NULL AND abs(x) > 90000 THEN 1 ELSE 0 END) = 0 AS retain FROM qc LEFT JOIN (SELECT subject, task FROM rz WHERE round(abs(z), 9) > 2) rz ON rz.subject = qc.subject AND rz.task = qc.task GROUP BY qc.subject, qc.task, qc.trial"),
        "retained_by_task": (QC, "SELECT task, count(*) AS n, CAST(sum(CASE WHEN retain THEN 1 ELSE 0 END) AS BIGINT) AS retained FROM (SELECT qc.task, qc.subject, qc.trial, max(CASE WHEN rz.subject IS NOT NULL AND abs(x) > 90000 THEN 1 ELSE 0 END) = 0 AS retain FROM qc LEFT JOIN (SELECT subject, task FROM rz WHERE round(abs(z), 9) > 2) rz ON rz.subject = qc.subject AND rz.task = qc.task GROUP BY qc.task, qc.subject, qc.trial) m GROUP BY task"),
        "mask_sources": (QC, "SELECT task, count(*) AS n, min(subject) AS first_subject, max(subject) AS last_subject FROM rz WHERE round(abs(z), 9) > 2 GROUP BY task"),
        "confusion_metrics": (DETECT, "SELECT tp, fp, fn, tn, round(tp * 1e0 / nullif(tp + fn, 0), 6) AS sensitivity, round(tn * 1e0 / nullif(tn + fp, 0), 6) AS specificity, round(tp * 1e0 / nullif(tp + fp, 0), 6) AS precision_, round(fp * 1e0 / nullif(tn + fp, 0), 6) AS fpr, round(2e0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM cf"),
        "average_precision": (DETECT, "SELECT round(sum(d * tp * 1e0 / n) / max(pos), 6) AS ap FROM (SELECT d, sum(d) OVER (ORDER BY s DESC) AS tp, sum(c) OVER (ORDER BY s DESC) AS n, sum(d) OVER () AS pos FROM (SELECT s, sum(y) AS d, count(*) AS c FROM sc GROUP BY s) a) b"),
        "topk_recall": (DETECT, "SELECT CAST(sum(CASE WHEN k <= n THEN y ELSE 0 END) AS BIGINT) AS hits, max(n) AS k, round(sum(CASE WHEN k <= n THEN y ELSE 0 END) * 1e0 / max(n), 6) AS recall FROM (SELECT y, row_number() OVER (ORDER BY s DESC, doc_id) AS k, CAST(sum(y) OVER () AS BIGINT) AS n FROM sc) q"),
        "wilson_fwer": (CELLS, "SELECT scenario, cell, n, k, round(rate, 6) AS rate, round(greatest(mid - half, 0), 6) AS low, round(least(mid + half, 1), 6) AS high FROM wi"),
        "scenario_rollup": (CELLS, "SELECT scenario, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS repetitions, round(avg(rate), 6) AS mean_rate, round(avg(score), 6) AS mean_score FROM wi GROUP BY scenario"),
        "choice_normalise": "SELECT event_id, CASE WHEN upper(trim(event_type)) IN ('CLICK', 'PURCHASE', 'SIGNUP') THEN 'C' WHEN upper(event_type) LIKE '%ERR%' OR upper(event_type) LIKE '%VIEW%' THEN 'D' END AS choice FROM {events}",
        "role_counts": "SELECT lower(trim(role)) AS role, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM {conversations} GROUP BY lower(trim(role))",
        "priority_decode": "SELECT o_orderpriority, CAST(substr(o_orderpriority, 1, 1) AS INT) AS level, count(*) AS n FROM {orders} GROUP BY o_orderpriority",
        "evidence_join": "SELECT s.s_suppkey AS unit, n.n_name AS nation, r.r_name AS region, round(sum(l.l_extendedprice * (1 - l.l_discount)), 0) AS effect, count(*) AS n FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey JOIN {lineitem} l ON l.l_suppkey = s.s_suppkey GROUP BY s.s_suppkey, n.n_name, r.r_name",
        "evidence_checks": "SELECT count(*) AS n, CAST(sum(CASE WHEN o.o_orderkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unmatched, CAST(sum(CASE WHEN l.l_shipdate < o.o_orderdate THEN 1 ELSE 0 END) AS BIGINT) AS shipped_before, CAST(sum(CASE WHEN c.c_custkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_customer, bool_and(l.l_quantity >= 0) AS nonnegative FROM {lineitem} l LEFT JOIN {orders} o ON o.o_orderkey = l.l_orderkey LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey",
        "unit_decode": "SELECT p_partkey AS unit_index, CAST(floor(p_partkey / 1083) AS BIGINT) AS condition, CAST(floor(p_partkey % 1083 / 361) AS BIGINT) AS dyad, CAST(floor(p_partkey % 361 / 19) AS BIGINT) AS ch1, p_partkey % 19 AS ch2 FROM {part}",
        "set_ops": "SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}) a UNION ALL SELECT 'customers only', count(*) FROM (SELECT c_nationkey AS k FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier}) b UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}) c",
        "set_equality": " UNION ALL ".join(
            f"SELECT '{name}' AS name, count(*) = 0 AS equal_sets, count(*) AS n_apart FROM ((SELECT {x} AS k FROM {{{one}}} EXCEPT SELECT {y} FROM {{{other}}}) UNION ALL (SELECT {y} FROM {{{other}}} EXCEPT SELECT {x} FROM {{{one}}})) q{name}"
            for name, one, x, other, y in (("suppliers", "supplier", "s_suppkey", "lineitem", "l_suppkey"), ("customers", "customer", "c_custkey", "orders", "o_custkey"), ("labelled", "documents", "doc_id", "labels", "doc_id"))
        ),
        "resume_antijoin": "SELECT o.o_orderkey FROM {orders} o LEFT JOIN (SELECT DISTINCT l_orderkey FROM {lineitem}) l ON l.l_orderkey = o.o_orderkey WHERE l.l_orderkey IS NULL",
        "provenance_hash": "SELECT item_id, sha256_of(text) AS sha256 FROM {benchmark}",
    }
    return {k: ("WITH" + v[0] + "\n" + v[1]) if isinstance(v, tuple) else v for k, v in q.items()}
