"""Quantiles, running sums and ranks against numpy, DuckDB and plain loops."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from synchro.operators import quantiles, ranks

PROBS = {"low": 0.01, "mid": 0.5, "high": 0.975, "first": 0.0, "last": 1.0}


@pytest.mark.parametrize("slack, accuracy", [(quantiles.SLACK, quantiles.ACCURACY), (0.0, 20)])
def test_quantiles_equal_duckdb(spark, tmp_path, slack, accuracy):
    """Groups of 1, 2 and 200,000 values, ties, negatives, nulls; coarse sketches whose brackets miss are made good."""
    rows = spark.range(260_000).select(
        F.expr("CASE WHEN id < 200000 THEN 'large' WHEN id < 250000 THEN NULL WHEN id < 259000 THEN 'tied' WHEN id = 259000 THEN 'one' WHEN id <= 259002 THEN 'two' ELSE 'none' END").alias("g"),
        F.expr("CASE WHEN id < 200000 THEN pow(pmod(hash(id), 100003) / 1000 - 40, 3) WHEN id < 250000 THEN pmod(hash(id), 7) WHEN id < 259000 THEN 2.5 WHEN id <= 259002 THEN id END").alias("x"),
    )
    rows.repartition(6).write.parquet(f"{tmp_path}/t")
    got = {r.g: r for r in quantiles.quantiles(spark.read.parquet(f"{tmp_path}/t"), ["g"], "x", PROBS, slack, accuracy).collect()}
    want = duckdb.sql(f"SELECT g, {', '.join(f'quantile_cont(x, {p}) AS {n}' for n, p in PROBS.items())} FROM '{tmp_path}/t/*.parquet' WHERE x IS NOT NULL GROUP BY g").df()
    assert len(got) == len(want) == 5
    for r in want.itertuples():
        own = got[None if r.g is None or r.g != r.g else r.g]
        assert [getattr(own, n) for n in PROBS] == pytest.approx([getattr(r, n) for n in PROBS], rel=1e-12)


def test_quantiles_of_a_whole_table_and_of_none(spark):
    got = quantiles.quantiles(spark.range(1001), [], "id", {"q": 0.25}).collect()
    assert [r.q for r in got] == [250.0]
    assert quantiles.quantiles(spark.range(0).withColumn("g", F.lit(1)), ["g"], "id", {"q": 0.5}).count() == 0


@pytest.mark.parametrize("n, parts", [(1_000, 4), (20_000, 7), (400_000, 16), (2_000_000, 5)])
def test_top_k_at_size(spark, n, parts):
    """Hits among the top and the whole count are right with columns that one side does not need, at any number of rows and partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = spark.range(n).select("id", F.expr("pmod(hash(id, 1), 50000)").alias("s"), F.expr("pmod(hash(id, 2), 4) = 0").cast("int").alias("y"), F.expr("repeat('x', 5)").alias("other"))
        k = n // 3
        got = ranks.running(rows, [F.col("s").desc(), F.col("id")], {"k": F.lit(1)})
        hits = got.agg(F.sum(F.when(F.col("k") <= k, F.col("y"))).alias("hits"), F.max("k").alias("n"), F.countDistinct("k").alias("kinds")).first()
        frame = rows.select("id", "s", "y").toPandas().sort_values(["s", "id"], ascending=[False, True])
        assert (hits.hits, hits.n, hits.kinds) == (frame.y.to_numpy()[:k].sum(), n, n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_running_within_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(None if k % 5 == 0 else f"g{k % 3}", k, None if k % 7 == 0 else int(rng.integers(9))) for k in range(3_000)]
    df = spark.createDataFrame(rows, "g string, k long, v int").repartition(5)
    got = {r.k: r for r in ranks.running(df, [F.col("k").desc()], {"n": F.lit(1), "total": F.col("v")}, ["g"]).collect()}
    so_far = {}
    for g, k, v in sorted(rows, key=lambda r: -r[1]):
        n, total = so_far.get(g, (0, 0))
        so_far[g] = n + 1, total + (v or 0)
        assert (got[k].n, got[k].total, got[k].g, got[k].v) == (*so_far[g], g, v)
    places = {(r.g, r.k): r.i for r in ranks.numbered(df, [F.col("k")], by=["g"]).collect()}
    for g in {r[0] for r in rows}:
        assert [places[g, k] for k in sorted(k for h, k, _ in rows if h == g)] == list(range(sum(h == g for h, _, _ in rows)))
