"""Removing rows by their ids: which rows are moved for it, and what is left in the scratch folder."""

import os

import pytest
from pyspark.sql import functions as F

from synchro.llm import common, neardup, toxicity


@pytest.mark.parametrize("kind", ["long", "int", "string", "decimal(20,0)"])
@pytest.mark.parametrize("rows", [1, 1 << 13])
def test_rows_of_no_gone_id_stay(spark, monkeypatch, kind, rows):
    """Ids of either sign, repeated and null ones; a sieve that holds back nearly all rows loses none of them."""
    monkeypatch.setattr(common, "SIEVE_ROWS", rows)
    monkeypatch.setattr(common, "SIEVE_ROW", 1 << 10)
    ids = [*range(-3000, 3000), 5, 6, None, None]
    docs = spark.createDataFrame([(x, f"t{n}", n) for n, x in enumerate(ids)], "doc_id long, text string, `row` int").withColumn("doc_id", F.col("doc_id").cast(kind))
    gone = [x for x in range(-3000, 3000) if x % 7 == 5] + [5, 10**6, None]
    got = common.without(docs, spark.createDataFrame([(x,) for x in gone + gone], "doc_id long"))
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert sorted(r.row for r in got.collect()) == [n for n, x in enumerate(ids) if x is None or x not in set(gone)]
    assert common.without(docs, docs.limit(0)).count() == len(ids)


@pytest.fixture(scope="module")
def tenth(spark):
    """Rows, and a written table of a tenth of their ids."""
    docs = spark.range(0, 200_000, 1, 4).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 20).alias("text"))
    return docs, common.saved(docs.where("doc_id % 10 = 3").select("doc_id"), "ids")


def test_few_rows_are_moved_to_meet_the_ids(spark, tenth):
    """Where ids are too many for Spark to send to all tasks, only rows of these and some 1 in 32 others are shuffled."""
    docs, gone = tenth
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = common.without(docs, gone).persist()
        assert left.count() == 180_000
        assert 20_000 <= max(_moved(left)) < 30_000
        left.unpersist()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_sieve_holds_back_all_ids_and_few_others(spark, tenth):
    through, held = common.sieved(*tenth)
    ids = {r.doc_id for r in held.select("doc_id").collect()}
    assert {x for x in range(200_000) if x % 10 == 3} <= ids and len(ids) < 20_000 + 200_000 / 25
    assert through.count() == 200_000 - len(ids)


def _moved(df) -> list[int]:
    """Records that each exchange of a persisted frame's plan wrote."""
    out, seen = [], [df._jdf.queryExecution().executedPlan()]
    while seen:
        node = seen.pop()
        name = node.nodeName()
        if name == "InMemoryTableScan":
            seen.append(node.relation().cachedPlan())
        elif name == "AdaptiveSparkPlan":
            seen.append(node.executedPlan())
        elif "QueryStage" in name:
            seen.append(node.plan())
        if name == "Exchange":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        seen += [children.apply(i) for i in range(children.size())]
    return out


def _left(spark) -> set[str]:
    return {x.rpartition("-")[0] for x in os.listdir(common.scratch_dir(spark).removeprefix("file:"))}


@pytest.fixture
def scratch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch_dir", lambda _: str(tmp_path))


def test_stages_leave_only_what_is_still_read(spark, sf_dir, scratch):
    docs = common.documents(spark, sf_dir)
    clean = toxicity.stage(spark, docs, sf_dir)
    assert _left(spark) == {"scores", "gone", "sieve"}
    once = neardup.stage(spark, clean, sf_dir)
    assert _left(spark) == {"scores", "gone", "sieve", "copies"}
    assert 0 < once.count() < clean.count() < docs.count()


def test_scratch_goes_when_a_step_fails(spark, scratch):
    with pytest.raises(ValueError), common.passing(spark):
        assert common.saved(spark.range(3), "inner").count() == 3
        assert _left(spark) == {"inner"}
        raise ValueError
    assert not _left(spark) and not common._PASSING
