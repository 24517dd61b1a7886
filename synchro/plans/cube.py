"""The sensor cube: every value of one participant against every value of another, and its label null.

Groups, trials and participants are those of `signals`; a trial is positive if its three labels are
below 7, a group is one block.  A part is a pair of participants with PART_SAMPLES samples of the first; its units
are these with every sample of the second, so 64-sample signals make 12,288 units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import label_null as nulls
from ..operators.phase import by_length

DRAWS, SEED, PART_SAMPLES = 30, 3100, 4
PAIRS = ((0, 1), (0, 2), (1, 2))


def _closeness(batches: Iterator) -> Iterator:
    """Per trial and part the closeness of each sample of the part to each sample of the other participant, as one array."""
    import pyarrow as pa

    for batch in batches:
        found = [{x.shape[1]: (rows, x) for rows, x in by_length(batch.column(f"v{p}"))} for p in range(3)]
        for a, z in PAIRS:
            for n in sorted(found[a].keys() & found[z].keys()):
                (rows_a, xa), (rows_z, xz) = found[a][n], found[z][n]
                rows = np.intersect1d(rows_a, rows_z)
                xa, xz = xa[np.searchsorted(rows_a, rows)], xz[np.searchsorted(rows_z, rows)]
                keep = [batch.column(k).take(pa.array(rows)) for k in ("b", "t", "y")]
                for i in range(0, n, PART_SAMPLES):
                    m = (1 / (1 + np.abs(xa[:, i : i + PART_SAMPLES, None] - xz[:, None, :]))).reshape(len(rows), -1)
                    xs = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * m.shape[1], pa.array(m.reshape(-1)))
                    names = pa.array([f"pair{a + 1}{z + 1}|{i}|{n}"] * len(rows))
                    yield pa.RecordBatch.from_arrays([names, *keep, xs], names=["part", "b", "t", "y", "xs"])


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part (pair, its first sample, samples a signal), b, t, y, xs."""
    who = F.col("vec_id") % 3
    signal = F.col("embedding").cast("array<double>")
    trials = (
        spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        .select("*", F.floor(F.col("vec_id") / 30).alias("b"), F.floor(F.col("vec_id") % 30 / 3).alias("t"))
        # a trial grows to 12,288 values: a number keeps adaptive execution from putting few trials into one task
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "b", "t")
        .groupBy("b", "t")
        .agg(F.min((F.col("label") < 7).cast("int")).alias("y"), F.count("*").alias("n"), *(F.max(F.when(who == p, signal)).alias(f"v{p}") for p in range(3)))
        .where("n = 3")
    )
    return trials.select("b", "t", "y", "v0", "v1", "v2").mapInArrow(_closeness, "part string, b long, t long, y int, xs array<double>")


def cube_label_null(spark: SparkSession, sf_dir: str, draws: int = DRAWS) -> DataFrame:
    got = nulls.label_null(cube(spark, sf_dir), draws, SEED)
    at = F.split("part", r"\|")
    samples = at[2].cast("long")
    sample = at[1].cast("long") + F.floor(F.col("place") / samples)
    shown = [F.round(c, 6).alias(c) for c in ("effect", "null_mean", "null_sd", "z", "p_unadjusted", "p_maxt")]
    return got.select(F.concat_ws("|", at[0], sample.cast("string")).alias("part"), (F.col("place") % samples).alias("place"), *shown, (F.col("p_maxt") < 0.05).alias("candidate"))


_M = nulls.mix_sql
ORACLE = f"""WITH sg AS (
  SELECT CAST(floor(vec_id / 30) AS BIGINT) AS b, CAST(floor(vec_id % 30 / 3) AS BIGINT) AS t, vec_id % 3 AS p, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings
), tt AS (
  SELECT CAST(floor(vec_id / 30) AS BIGINT) AS b, CAST(floor(vec_id % 30 / 3) AS BIGINT) AS t, min(CASE WHEN label < 7 THEN 1 ELSE 0 END) AS y FROM embeddings GROUP BY 1, 2 HAVING count(*) = 3
), w AS (SELECT b, sum(y) AS n1, count(*) AS n FROM tt GROUP BY b HAVING sum(y) > 0 AND sum(y) < count(*)
), tot AS (SELECT sum(n1 * (n - n1) * 1e0 / n) AS w_all FROM w
), k1 AS (SELECT range AS r, {_M(f"range + {SEED}")} AS h FROM range({DRAWS})
), k2 AS (SELECT r, b, n1, n, {_M(f"(h + b) % {nulls.PRIME}")} AS h FROM k1 CROSS JOIN w
), k3 AS (SELECT r, b, n1, n, {_M("h")} AS h FROM k2
), k4 AS (SELECT r, k3.b, n1, n, t, {_M(f"(h + t * 7919) % {nulls.PRIME}")} AS h FROM k3 JOIN tt ON tt.b = k3.b
), k5 AS (SELECT r, b, n1, n, t, {_M("h")} AS h FROM k4
), k6 AS (SELECT r, b, n1, n, t, row_number() OVER (PARTITION BY r, b ORDER BY {_M("h")}, t) AS k FROM k5
), co AS (
  SELECT r, b, t, CASE WHEN k <= n1 THEN n - n1 ELSE -n1 END * 1e0 / n / w_all AS c FROM k6 CROSS JOIN tot UNION ALL
  SELECT -1, tt.b, t, CASE WHEN y = 1 THEN n - n1 ELSE -n1 END * 1e0 / n / w_all FROM tt JOIN w ON w.b = tt.b CROSS JOIN tot
), ux AS (
  SELECT concat('pair', a.p + 1, z.p + 1, '|', a.i) AS part, z.i AS place, a.b, a.t, 1 / (1 + abs(a.x - z.x)) AS x FROM sg a JOIN sg z ON z.b = a.b AND z.t = a.t AND a.p < z.p
), e AS (SELECT part, place, r, sum(x * c) AS e FROM ux JOIN co ON co.b = ux.b AND co.t = ux.t GROUP BY part, place, r
), st AS (SELECT part, place, max(CASE WHEN r < 0 THEN e END) AS effect, avg(CASE WHEN r >= 0 THEN e END) AS m, stddev_samp(CASE WHEN r >= 0 THEN e END) AS s FROM e GROUP BY part, place
), nz AS (SELECT st.*, r, CASE WHEN s > 1e-12 THEN round(abs((e - m) / s), 9) END AS z, CASE WHEN s > 1e-12 THEN round((effect - m) / s, 9) END AS own FROM e JOIN st ON st.part = e.part AND st.place = e.place WHERE r >= 0
), mx AS (SELECT nz.*, coalesce(max(z) OVER (PARTITION BY r), 0) AS top FROM nz
)
SELECT part, CAST(place AS BIGINT) AS place, round(max(effect), 6) AS effect, round(max(m), 6) AS null_mean, round(max(s), 6) AS null_sd, round(max(own), 6) AS z,
  round(CASE WHEN max(own) IS NULL THEN 1e0 ELSE (1 + count(CASE WHEN z >= abs(own) THEN 1 END)) * 1e0 / ({DRAWS} + 1) END, 6) AS p_unadjusted,
  round(CASE WHEN max(own) IS NULL THEN 1e0 ELSE (1 + count(CASE WHEN top >= abs(own) THEN 1 END)) * 1e0 / ({DRAWS} + 1) END, 6) AS p_maxt,
  CASE WHEN max(own) IS NULL THEN false ELSE (1 + count(CASE WHEN top >= abs(own) THEN 1 END)) * 1e0 / ({DRAWS} + 1) < 0.05 END AS candidate
FROM mx GROUP BY part, place"""
