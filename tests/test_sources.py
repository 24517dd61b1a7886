"""Scans with contracts and sinks that resume."""

import pytest

from synchro.sources import files


def test_csv_round_trip_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, s string")
    files.export_csv(df, str(tmp_path / "some"))
    assert sorted(map(tuple, files.delimited(spark, str(tmp_path / "some"), "k long, s string").collect())) == [(1, "a"), (2, None)]
    files.export_csv(df.where("k > 5"), str(tmp_path / "none"))
    assert files.delimited(spark, str(tmp_path / "none"), "k long, s string", allow_empty=True).count() == 0
    with pytest.raises(ValueError):
        files.delimited(spark, str(tmp_path / "none"), "k long, s string")


def test_tsv_with_a_bad_cell_fails(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("trial\tchoice\n1\tC\nx\tD\n")
    with pytest.raises(Exception):
        files.delimited(spark, str(tmp_path / "t.tsv"), "trial int, choice string", sep="\t").collect()


def test_contract(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], "clean")], "k long, x array<double>, mode string")
    assert files.checked(df, ["k", "x"], {"x": 2}, {"mode": "clean"}).count() == 1
    with pytest.raises(ValueError):
        files.checked(df, ["y"])
    rows = [(2, [0.0], "clean"), (2, [0.0, float("nan")], "clean"), (2, [0.0, float("inf")], "clean"), (2, None, "clean"), (2, [0.0, 1.0], None)]
    for row in rows:
        with pytest.raises(Exception, match="contract"):
            files.checked(df.union(spark.createDataFrame([row], df.schema)), ["k"], {"x": 2}, {"mode": "clean"}).collect()


def test_unique(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "k long, s string")
    assert files.unique(df, ["k"]).count() == 2
    with pytest.raises(ValueError):
        files.unique(df.union(df), ["k"])


def test_append_and_resume(spark, tmp_path):
    path = str(tmp_path / "runs")
    work = spark.createDataFrame([(c, r) for c in (1, 2) for r in range(3)], "cell long, rep long")
    assert files.pending(work, path, ["cell", "rep"]).count() == 6
    files.append(work.where("cell = 1"), path, ["cell"])
    rest = files.pending(work, path, ["cell", "rep"])
    assert sorted(map(tuple, rest.collect())) == [(2, 0), (2, 1), (2, 2)]
    files.append(rest, path, ["cell"])
    assert files.pending(work, path, ["cell", "rep"]).count() == 0 and spark.read.parquet(path).count() == 6


def test_an_append_that_is_tried_again_adds_nothing_twice(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = spark.createDataFrame([(c, r) for c in (1, 2, 3) for r in range(3)], "cell long, rep long")
    for part in ("cell = 1", "cell IN (1, 2)", "cell IN (1, 2)", "cell = 3"):
        files.append(rows.where(part), path, ["cell"])
    assert sorted(map(tuple, spark.read.parquet(path).select("cell", "rep").collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError):
        files.append(rows, path, [])


def test_only_whole_tables_are_done(spark, tmp_path):
    path = f"{tmp_path}/step"
    assert not files.done(spark, path)
    spark.range(3).write.parquet(path)
    assert files.done(spark, path)
    (tmp_path / "step" / "_SUCCESS").unlink()
    assert not files.done(spark, path)
