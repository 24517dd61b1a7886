"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Orders of the ids, one a round, so that no chain of ids is walked link by link.
_ORDERS = (0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x7F4A7C15F39CC060, 0x61C8864680B583EB)


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of links (a, b).

    Each round every node points to the smallest of itself and its neighbours in the round's order
    of ids; links move to what their ends point to.  Links between different nodes shrink by a
    factor a round.  A node with very many links meets in aggregates and splittable joins only.
    """
    links = C.saved(links.select("a", "b").where("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not links.isEmpty():
        order = F.lit(_ORDERS[len(steps) % len(_ORDERS)])
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(order)).alias("best"))
        step = best.select(F.col("a").alias("node"), F.least(F.col("a").bitwiseXOR(order), "best").bitwiseXOR(order).alias("to"))
        step = C.saved(step, "step")
        steps.append(step)
        moved = links.join(step.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a")
        moved = moved.join(step.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b").where("to_a <> to_b")
        links = C.saved(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = steps[0].withColumnRenamed("to", "root")
    for step in steps[1:]:
        roots = roots.join(step.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    roots = C.saved(roots, "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(least, "root").select("node", "component")
