"""Frozen evidence, gates, running sums, settings and files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from synchro.operators import evidence, ranks
from synchro.sources import config


def _stage(spark, rows):
    return spark.createDataFrame(rows, "unit int, band string, effect double")


def test_freeze_only_if_all_checks_hold(spark, tmp_path):
    good = {"a": _stage(spark, [(1, "x", 0.5), (2, "y", 0.1)]), "b": _stage(spark, [(1, "x", 0.5000015), (2, "y", 0.1)])}
    checks = evidence.compared(good, "unit", "effect", ["band"])
    assert checks.count() == 6 and checks.where("not ok").count() == 0
    evidence.freeze(checks, good["a"], f"{tmp_path}/frozen")
    assert evidence.frozen(spark, f"{tmp_path}/frozen").count() == 2
    for name, rows in {
        "effect_consistent of 1": [(1, "x", 0.50001), (2, "y", 0.1)], "metadata_consistent of 2": [(1, "x", 0.5), (2, "z", 0.1)], "present_once_in_all_stages of 2": [(1, "x", 0.5)],
        "present_once_in_all_stages of 1": [(1, "x", 0.5), (1, "x", 0.5), (2, "y", 0.1)],
    }.items():
        with pytest.raises(ValueError, match=name):
            evidence.freeze(evidence.compared(good | {"b": _stage(spark, rows)}, "unit", "effect", ["band"]), good["a"], f"{tmp_path}/other")
    null = evidence.compared(good | {"b": _stage(spark, [(1, "x", None), (2, "y", 0.1)])}, "unit", "effect", ["band"])
    assert [(r.name, r.unit) for r in null.where("not ok").collect()] == [("effect_consistent", "1")]
    with pytest.raises(ValueError, match="no check"):
        evidence.freeze(checks.limit(0), good["a"], f"{tmp_path}/other")
    assert not (tmp_path / "other").exists()


def test_only_whole_freezes_are_read(spark, tmp_path):
    """No manifest, no freeze; what a broken one left is replaced, a whole one is not; a changed file is found out."""
    table, path = _stage(spark, [(1, "x", 0.5), (2, "y", 0.1)]), f"{tmp_path}/own"
    checks = evidence.patterns(table, "unit", {"known": "band IS NOT NULL"})
    with pytest.raises(FileNotFoundError):
        evidence.frozen(spark, path)
    table.write.parquet(f"{path}/master")  # a freeze that broke off before its manifest
    with pytest.raises(FileNotFoundError):
        evidence.frozen(spark, path)
    (tmp_path / "source.txt").write_text("of the evidence")
    evidence.freeze(checks, table, path, [f"{tmp_path}/source.txt"])
    assert evidence.frozen(spark, path).count() == 2 and spark.read.json(f"{path}/record").where("ok").count() == 2
    manifest = json.loads((tmp_path / "own" / evidence.MANIFEST).read_text())
    assert {f["sha256"] for f in manifest["files"]} >= {hashlib.sha256(b"of the evidence").hexdigest()} and manifest["checks"] == 2
    with pytest.raises(FileExistsError):
        evidence.freeze(checks, table, path)
    (tmp_path / "source.txt").write_text("of other evidence")
    with pytest.raises(ValueError, match=r"source\.txt"):
        evidence.frozen(spark, path)


def test_effects_reconcile_by_both_tolerances(spark):
    left = _stage(spark, [(1, "x", 1000.0), (2, "y", 1e-8), (3, "z", 1.0), (4, "w", None), (5, "v", 1.0), (5, "v", 1.0)])
    right = _stage(spark, [(1, "x", 1000.009), (2, "y", 9e-8), (3, "z", 1.0002), (4, "w", 0.0), (5, "v", 1.0), (6, "u", 1.0)])
    got = {r.unit: r.ok for r in evidence.reconciled(left, right, "unit", "effect").collect()}
    assert got == {"1": True, "2": True, "3": False, "4": False, "5": False, "6": False}


def test_patterns_fail_on_null(spark):
    got = evidence.patterns(_stage(spark, [(1, "x", 0.5), (2, "y", None)]), "unit", {"large": "effect > 0.2", "named": "band = 'x'"})
    assert {(r.name, r.unit): r.ok for r in got.collect()} == {("large", "1"): True, ("named", "1"): True, ("large", "2"): False, ("named", "2"): False}


def test_family_of_exactly_three(spark):
    df = spark.createDataFrame([(1, "True"), (2, " yes "), (3, "1"), (4, "no"), (5, None)], "unit int, passed string")
    assert sorted(r.unit for r in evidence.final_family(df, "passed", 3).collect()) == [1, 2, 3]
    for n in (2, 4):
        with pytest.raises(ValueError):
            evidence.final_family(df, "passed", n)


def test_gate_and_reports(spark, tmp_path):
    config.report(spark, ["summary", "RESULT", "  PASS"], f"{tmp_path}/good")
    config.report(spark, ["summary", "RESULT", "  FAIL"], f"{tmp_path}/bad")
    evidence.stage_gate(spark, f"{tmp_path}/good")
    with pytest.raises(ValueError):
        evidence.stage_gate(spark, f"{tmp_path}/bad")


def test_file_hashes(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\x00abc")
    r = evidence.file_hashes(spark, f"{tmp_path}/a.bin").first()
    assert (r.bytes, r.sha256) == (4, hashlib.sha256(b"\x00abc").hexdigest())
    (tmp_path / "more").mkdir()
    big = bytes(range(256)) * 20_000  # several chunks
    (tmp_path / "more" / "b.bin").write_bytes(big)
    (tmp_path / "more" / "c.bin").write_bytes(b"")
    (tmp_path / "more" / "_hidden").write_bytes(b"1")
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in evidence.file_hashes(spark, f"file://{tmp_path}/more").collect()}
    assert got == {"b.bin": (len(big), hashlib.sha256(big).hexdigest()), "c.bin": (0, hashlib.sha256(b"").hexdigest())}
    with pytest.raises(Exception, match="nowhere"):
        evidence.file_hashes(spark, f"{tmp_path}/nowhere").count()


def test_running_sums(spark):
    rows = spark.range(1000).select("id", ((F.col("id") * 7919) % 1000).alias("s"), (F.col("id") % 3).alias("v"))
    got = {r.s: r for r in ranks.running(rows, [F.col("s").desc()], {"n": F.lit(1), "total": F.col("v")}).collect()}
    total = 0
    for i, s in enumerate(sorted(got, reverse=True)):
        total += got[s].v
        assert (got[s].n, got[s].total) == (i + 1, total)
    assert ranks.running(rows.limit(0), [F.col("s")], {"n": F.lit(1)}).count() == 0


def test_settings(spark, tmp_path):
    (tmp_path / "configs").mkdir()
    own = {"project_root": ".", "cleaned_dir": "clean", "reference_preprocessing_repo": "other", "dataset_root": "data", "results_root": "/abs/results", "inference": {"artifact_sensitivity_mask": "mask.npz", "alpha": 0.05}, "eligible_task_bands": [["b", "beta"], ["a", "alpha"]]}
    (tmp_path / "configs" / "c.json").write_text(json.dumps(own))
    got = config.load(str(tmp_path / "configs" / "c.json"))
    assert got["dataset_root"] == str(tmp_path / "data") and got["results_root"] == "/abs/results" and got["inference"]["artifact_sensitivity_mask"] == str(tmp_path / "mask.npz")
    assert got["reference_preprocessing_repo"] == str(tmp_path / "other") and got["project_root"] == str(tmp_path)
    del own["cleaned_dir"]
    (tmp_path / "configs" / "less.json").write_text(json.dumps(own))
    with pytest.raises(KeyError, match="cleaned_dir"):
        config.load(str(tmp_path / "configs" / "less.json"))
    assert [(r.task, r.band) for r in config.conditions(spark, got).orderBy("place").collect()] == [("b", "beta"), ("a", "alpha")]
    config.snapshot(spark, got, f"{tmp_path}/used")
    assert json.loads(spark.read.text(f"{tmp_path}/used", wholetext=True).first().value) == got


def test_files_by_name(spark, tmp_path):
    for name in ("x/s1_eeg.set", "y/s2_eeg.set", "z/s2_eeg.set"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    found = config.find_one(spark, str(tmp_path), "s1_eeg.set")
    assert found.endswith("x/s1_eeg.set") and config.sidecar(found).endswith("x/s1_events.tsv")
    for name in ("s2_eeg.set", "s3_eeg.set"):
        with pytest.raises(FileNotFoundError):
            config.find_one(spark, str(tmp_path), name)
    with pytest.raises(ValueError):
        config.sidecar("a/b.txt")
    df = spark.createDataFrame([("a/b_eeg.set",), ("a/b.txt",)], "p string").select(config.sidecar_column(F.col("p")).alias("p"))
    assert [r.p for r in df.collect()] == ["a/b_events.tsv", None]
