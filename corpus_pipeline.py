"""From raw documents to packed sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from synchro.llm import common, decontaminate, neardup, packing, pii, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("near-dedup", neardup.stage),
    ("decontamination", decontaminate.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]

#: Classifiers, registers and tokenizers are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of sf_dir's documents; stages hand on written tables, not plans."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
