"""Behavioural records: normalised trial numbers and choices, and choice vectors whose keys must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a choice may be written, in upper case.
COOPERATE = ["C", "COOP", "COOPERATE", "COOPERATION", "1", "1.0"]
DEFECT = ["D", "DEFECT", "DEFECTION", "2", "2.0", "0", "0.0"]
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def trial_number(raw: Column) -> Column:
    """Blank is null, a number is rounded half to even, else the first run of digits counts; null without one."""
    text = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    number = F.when(text.rlike(_NUMBER), F.bround(text.try_cast("double"), 0).try_cast("long"))
    digits = F.regexp_extract(text, "([0-9]+)", 1)
    return F.coalesce(number, F.when(digits != "", digits.try_cast("long")))


def choice(raw: Column) -> Column:
    """C or D by the fixed spellings, then by what the text contains; null for anything else."""
    text = F.upper(F.trim(F.coalesce(raw.cast("string"), F.lit(""))))
    exact = F.when(text.isin(COOPERATE), "C").when(text.isin(DEFECT), "D")
    return exact.when(text.contains("COOP"), "C").when(text.contains("DEFECT"), "D")


def choice_vectors(rows: DataFrame, keys: list[str], trial: str, raw: str, n_trials: int | None = None) -> DataFrame:
    """keys, choices: each participant's choices in order of trials.

    Rows without a trial number or a choice are dropped, and equal repeats count once.  A trial with both choices fails
    the query, and so does a participant whose trials are not 1 to n_trials (or, without it, 1 to their number).
    """
    known = rows.select(*keys, trial_number(F.col(trial)).alias("t"), choice(F.col(raw)).alias("c")).where("t is not null and c is not null")
    each = known.groupBy(*keys, "t").agg(F.min("c").alias("c"), F.max("c").alias("other"))
    each = each.withColumn("c", F.when(F.col("c") == F.col("other"), F.col("c")).otherwise(F.raise_error(F.concat(F.lit("conflicting choices at trial "), F.col("t").cast("string")))))
    whole = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "c"))).alias("v"))  # one row a trial of one participant
    wanted = F.sequence(F.lit(1), F.lit(n_trials) if n_trials else F.size("v")).cast("array<bigint>")
    good = F.transform("v", lambda x: x["t"]) == wanted
    return whole.select(*keys, F.when(good, F.transform("v", lambda x: x["c"])).otherwise(F.raise_error(F.lit("trials are not complete"))).alias("choices"))
