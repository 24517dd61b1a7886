"""Queries in DataFrame form whose oracles are SQL of their own: records, keys, evidence across stages, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import behavior, evidence, ranks
from . import dialect, inference, nulls

#: Raw trial numbers and choices in the spellings that normalisers meet, from the event stream.
_RAW = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat(CAST(user_id AS STRING), '.5') WHEN 1 THEN concat('trial ', CAST(user_id AS STRING), ' of 9') WHEN 2 THEN '  ' WHEN 3 THEN concat(' ', CAST(user_id AS STRING), '.0 ')
    WHEN 4 THEN 'none' ELSE concat(CAST(user_id AS STRING), 'e1') END AS trial,
  CASE event_type WHEN 'click' THEN ' coop' WHEN 'purchase' THEN '1.0' WHEN 'signup' THEN 'Cooperated' WHEN 'view' THEN 'he defects' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN '0' ELSE '?' END END AS choice
FROM events"""


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.sql(_RAW.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return raw.select("event_id", behavior.trial_number(F.col("trial")).alias("trial"), behavior.choice(F.col("choice")).alias("choice"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as trials, its speakers as choices: users cooperate, others don't."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", (F.col("turn") + 1).alias("trial"), F.when(F.col("role") == "user", "coop").otherwise("Defect").alias("choice"))
    return behavior.choice_vectors(rows, ["conv_id"], "trial", "choice").select("conv_id", F.array_join("choices", "").alias("choices"))


#: The stages of the event stream's units, by query; all state the effect, and each computes it apart from the others: from trials' coefficients,
#: beside a null, from sums by group, from leave-one-out totals, and from the groups' block effects put together again.
STAGES = {"observed": ("observed_effects", "block_effect"), "label": ("label_null_maxt", "effect"), "bundle": ("effects_bundle", "block_effect"), "stability": ("candidate_audit", "effect"), "recombined": ("effect_reconciliation", "recombined")}


def _runs() -> dict:
    return {name: lambda spark, sf_dir, text=text: dialect.run(spark, sf_dir, text) for name, text in inference.texts().items()} | nulls.frames()


def stages(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    run = _runs()
    return {k: run[q](spark, sf_dir).select("unit", F.split_part("unit", F.lit("|"), F.lit(1)).alias("dyad"), F.split_part("unit", F.lit("|"), F.lit(2)).alias("measure"), F.col(x).alias("effect")) for k, (q, x) in STAGES.items()}


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _runs()
    rule = evidence.patterns(run["label_null_maxt"](spark, sf_dir), "unit", {"family_p_not_below_own": "p_maxt >= p_unadjusted"})
    whole = evidence.patterns(run["candidate_audit"](spark, sf_dir), "unit", {"estimates_around_effect": "loto_min <= effect AND effect <= loto_max"})
    return evidence.compared(stages(spark, sf_dir), "unit", "effect", ["dyad", "measure"]).unionByName(rule).unionByName(whole).select("name", "unit", "ok")


def _checks_oracle() -> str:
    texts = {k: dialect.duckdb_text(v) for k, v in inference.texts().items()} | nulls.oracles()
    rows = " UNION ALL ".join(f"SELECT '{k}' AS stage, unit, {x} AS effect FROM ({texts[q]}) {k}" for k, (q, x) in STAGES.items())
    n = len(STAGES)
    return f"""WITH al AS ({rows}
), by_unit AS (
  SELECT unit, count(*) AS n, count(DISTINCT stage) AS k, count(DISTINCT split_part(unit, '|', 1) || split_part(unit, '|', 2)) AS metas, max(CASE WHEN stage = 'observed' THEN effect END) AS base, min(effect) AS low, max(effect) AS high FROM al GROUP BY unit
)
SELECT 'present_once_in_all_stages' AS name, unit, n = {n} AND k = {n} AS ok FROM by_unit UNION ALL
SELECT 'metadata_consistent', unit, metas = 1 FROM by_unit UNION ALL
SELECT 'effect_consistent', unit, n = {n} AND greatest(high - base, base - low) < 2e-6 FROM by_unit UNION ALL
SELECT 'family_p_not_below_own', unit, p_maxt >= p_unadjusted FROM ({texts["label_null_maxt"]}) a UNION ALL
SELECT 'estimates_around_effect', unit, loto_min <= effect AND effect <= loto_max FROM ({texts["candidate_audit"]}) b"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, y, s of the labelled documents: what a detector scored."""
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    return marks.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("n_chars").alias("s")), "doc_id")


def _average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_score = _scored(spark, sf_dir).groupBy("s").agg(F.sum("y").alias("d"), F.count("*").alias("c"))
    rows = ranks.running(by_score, [F.col("s").desc()], {"tp": F.col("d"), "n": F.col("c")})
    return rows.agg(F.round(F.sum(F.col("d") * F.col("tp") / F.col("n")) / F.sum("d"), 6).alias("ap"))


def _topk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranks.running(_scored(spark, sf_dir), [F.col("s").desc(), F.col("doc_id")], {"k": F.lit(1)})
    n = _scored(spark, sf_dir).agg(F.sum("y").cast("long").alias("n"))  # one row
    hits = F.sum(F.when(F.col("k") <= F.col("n"), F.col("y")).otherwise(0)).cast("long")
    return rows.crossJoin(F.broadcast(n)).agg(hits.alias("hits"), F.max("n").alias("k"), F.round(hits / F.max("n"), 6).alias("recall"))


def frames() -> dict:
    return {"trial_choice_normalise": _normalised, "choice_vectors": _vectors, "evidence_freeze_checks": _checks, "average_precision": _average_precision, "topk_recall": _topk_recall}


def oracles() -> dict[str, str]:
    return {
        "trial_choice_normalise": f"""WITH raw AS ({_RAW})
SELECT event_id, coalesce(CAST(round_even(TRY_CAST(trim(trial) AS DOUBLE), 0) AS BIGINT), TRY_CAST(nullif(regexp_extract(trial, '([0-9]+)', 1), '') AS BIGINT)) AS trial,
  CASE WHEN upper(trim(choice)) IN ('C', 'COOP', 'COOPERATE', 'COOPERATION', '1', '1.0') THEN 'C' WHEN upper(trim(choice)) IN ('D', 'DEFECT', 'DEFECTION', '2', '2.0', '0', '0.0') THEN 'D'
    WHEN contains(upper(choice), 'COOP') THEN 'C' WHEN contains(upper(choice), 'DEFECT') THEN 'D' END AS choice
FROM raw""",
        "choice_vectors": "SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'C' ELSE 'D' END, '' ORDER BY turn) AS choices FROM conversations GROUP BY conv_id",
        "evidence_freeze_checks": _checks_oracle(),
    }
