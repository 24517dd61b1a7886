"""Exact, interpolated quantiles of groups of any size.

1. Sketches (merged before the shuffle) bracket every wanted rank by two values that are close to it.
2. One read counts by group what lies below a bracket, and the distinct values inside it.  Only these move.
3. Their running counts, over ranges of values, tell the value at the rank and at the next one.

A bracket that a sketch put amiss is found out by its counts, and its ranks are taken from all values.
No task holds a group: counts add up before they move, and the values of one bracket go to several ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import saved
from .ranks import running

#: The sketches' error is 1 / ACCURACY of a group; brackets reach SLACK of it to either side.
ACCURACY = 10_000
SLACK = 4 / ACCURACY
#: Groups whose brackets are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 100_000


def _counted(values: DataFrame, brackets: DataFrame, by: list[str], small: bool) -> DataFrame:
    """by, name, v, c: rows below the bracket (v null), and how often each value inside comes up."""
    own = brackets.select(*(F.col(c).alias(f"__by{k}") for k, c in enumerate(by)), "__targets")
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{k}"))
    rows = values.join(F.broadcast(own) if small else own, same).select(*by, "__x", F.explode("__targets").alias("__t"))
    rows = rows.where(F.col("__t.high").isNull() | (F.col("__x") <= F.col("__t.high")))
    inside = F.when(F.col("__t.low").isNull() | (F.col("__x") >= F.col("__t.low")), F.col("__x"))
    return rows.groupBy(*by, F.col("__t.name").alias("__name"), inside.alias("__v")).agg(F.count("*").alias("__c"))


def _picked(values: DataFrame, brackets: DataFrame, by: list[str], small: bool) -> DataFrame:
    """by, name, low, high: the values at each target's rank and at the next one; null where the bracket misses it."""
    cells = running(_counted(values, brackets, by, small), [F.col("__v").asc_nulls_first()], {"__so_far": F.col("__c")}, [*by, "__name"])
    targets = brackets.select(*(F.col(c).alias(f"__by{k}") for k, c in enumerate(by)), F.explode("__targets").alias("__t"))
    same = F.col("__name") == F.col("__t.name")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{k}"))
    cells = cells.join(F.broadcast(targets) if small else targets, same)
    at = lambda rank: F.max(F.when((F.col("__so_far") > rank) & (F.col("__so_far") - F.col("__c") <= rank), F.col("__v")))
    return cells.groupBy(*by, "__name").agg(at(F.col("__t.rank")).alias("__low"), at(F.col("__t.next")).alias("__high"), F.max("__t.part").alias("__part"))


def _brackets(values: DataFrame, by: list[str], probs: dict[str, float], slack: float, accuracy: int) -> DataFrame:
    """by, targets: for each name its rank, the next one, the part of the way between, and the bracket."""
    p = [x for q in probs.values() for x in (max(q - slack, 0.0), min(q + slack, 1.0))]
    rows = values.groupBy(*by).agg(F.count("*").alias("__n"), F.percentile_approx("__x", p, accuracy).alias("__q"))
    each = []
    for k, (name, q) in enumerate(probs.items()):
        at = F.lit(q) * (F.col("__n") - 1)
        rank = F.floor(at).cast("long")
        each.append(F.struct(F.lit(name).alias("name"), rank.alias("rank"), F.least(rank + 1, F.col("__n") - 1).alias("next"), (at - rank).alias("part"), F.get("__q", F.lit(2 * k)).alias("low"), F.get("__q", F.lit(2 * k + 1)).alias("high")))
    return rows.select(*by, F.array(*each).alias("__targets"))


def quantiles(df: DataFrame, by: list[str], value: str | Column, probs: dict[str, float], slack: float = SLACK, accuracy: int = ACCURACY) -> DataFrame:
    """by, and one column a name of probs: the quantile at that probability, interpolated between neighbours.

    Nulls are not counted; groups without a value have no row.  A null in `by` is a group of its own.
    """
    values = df.select(*by, (F.col(value) if isinstance(value, str) else value).cast("double").alias("__x")).where("__x IS NOT NULL")
    brackets = saved(_brackets(values, by, probs, slack, accuracy), "brackets")
    small = brackets.count() <= BROADCAST_GROUPS
    got = saved(_picked(values, brackets, by, small), "picked")
    missed = got.where(F.col("__low").isNull() | F.col("__high").isNull())
    if not missed.isEmpty():  # a sketch beyond its error: these groups are taken whole
        whole = F.transform("__targets", lambda t: F.struct(t["name"].alias("name"), t["rank"].alias("rank"), t["next"].alias("next"), t["part"].alias("part"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")))
        groups = missed.select(*(F.col(c).alias(f"__by{k}") for k, c in enumerate(by))).distinct()
        same = F.lit(True)
        for k, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"__by{k}"))
        again = _picked(values, brackets.join(groups, same, "left_semi").withColumn("__targets", whole), by, small)
        got = got.join(groups, same, "left_anti").unionByName(again)
    between = F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__part")
    exact = F.when(F.col("__part") == 0, F.col("__low")).otherwise(between)
    return got.groupBy(*by).agg(*(F.max(F.when(F.col("__name") == name, exact)).alias(name) for name in probs))
