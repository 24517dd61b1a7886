"""Evidence that is frozen only if every check holds: families, effects and passes across stages."""

from __future__ import annotations

import contextlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import digests


def final_family(df: DataFrame, flag: str, n: int) -> DataFrame:
    """Rows whose flag (boolean, or text such as yes and true) holds; an error unless there are exactly n."""
    yes = F.lower(F.trim(F.col(flag).cast("string"))).isin("1", "true", "yes", "y")
    rows = df.where(F.coalesce(yes, F.lit(False))).limit(n + 1).collect()  # n rows and one more at most: what is counted is what is returned
    if len(rows) != n:
        raise ValueError(f"expected exactly {n} rows with {flag}, found {'more' if len(rows) > n else len(rows)}")
    return df.sparkSession.createDataFrame(rows, df.schema)


def stage_gate(spark: SparkSession, path: str, needle: str = "RESULT\n  PASS") -> None:
    """An error unless the report of an earlier stage holds its pass text."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one short report
    if needle not in text:
        raise ValueError(f"{path} does not state {needle!r}")


def compared(stages: dict[str, DataFrame], key: str, effect: str, meta: list[str], tolerance: float = 2e-6) -> DataFrame:
    """A check table (name, unit, ok, details) of stages that must speak of the same units.

    By unit: that every stage holds it once, that the meta columns are the same in all, and that effects
    differ from the first stage's by less than the tolerance.  Null effects and null meta columns don't compare.
    """
    rows = [d.select(F.lit(name).alias("stage"), F.col(key).cast("string").alias("unit"), F.to_json(F.struct(*meta)).alias("meta"), F.col(effect).cast("double").alias("effect")) for name, d in stages.items()]
    first, n = next(iter(stages)), len(stages)
    by = reduce(DataFrame.unionByName, rows).groupBy("unit").agg(
        F.count("*").alias("rows"), F.countDistinct("stage").alias("in_stages"), F.count("effect").alias("effects"), F.min("meta").alias("meta_low"), F.max("meta").alias("meta_high"),
        F.max(F.when(F.col("stage") == first, F.col("effect"))).alias("base"), F.min("effect").alias("low"), F.max("effect").alias("high"),
    )
    once = (F.col("rows") == n) & (F.col("in_stages") == n)
    near = (F.col("effects") == n) & (F.greatest(F.col("high") - F.col("base"), F.col("base") - F.col("low")) < tolerance)
    tests = {
        "present_once_in_all_stages": (once, F.concat_ws(" of ", F.col("in_stages"), F.lit(n))),
        "metadata_consistent": (F.col("meta_low") == F.col("meta_high"), F.col("meta_low")),
        "effect_consistent": (near, F.concat_ws(" to ", F.round("low", 9).cast("string"), F.round("high", 9).cast("string"))),
    }
    each = F.array(*(F.struct(F.lit(k).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), d.alias("details")) for k, (ok, d) in tests.items()))
    return by.select("unit", F.explode(each).alias("c")).select("c.name", "unit", "c.ok", "c.details")


def patterns(df: DataFrame, key: str, expected: dict[str, str]) -> DataFrame:
    """Checks by unit of SQL conditions that must hold; one that is null fails."""
    each = F.array(*(F.struct(F.lit(k).alias("name"), F.coalesce(F.expr(v), F.lit(False)).alias("ok"), F.lit(v).alias("details")) for k, v in expected.items()))
    return df.select(F.col(key).cast("string").alias("unit"), F.explode(each).alias("c")).select("c.name", "unit", "c.ok", "c.details")


def reconciled(left: DataFrame, right: DataFrame, key: str, effect: str, rtol: float = 1e-5, atol: float = 1e-7) -> DataFrame:
    """A check table: by unit, that both state the effect once and that they differ by atol + rtol * |right| at most."""
    rows = left.select(F.col(key).cast("string").alias("unit"), F.lit(0).alias("side"), F.col(effect).cast("double").alias("x")).unionByName(right.select(F.col(key).cast("string").alias("unit"), F.lit(1).alias("side"), F.col(effect).cast("double").alias("x")))
    by = rows.groupBy("unit").agg(*(F.max(F.when(F.col("side") == k, F.col("x"))).alias(c) for k, c in ((0, "a"), (1, "b"))), F.sum(1 - F.col("side")).alias("n_a"), F.sum("side").alias("n_b"))
    near = (F.col("n_a") == 1) & (F.col("n_b") == 1) & (F.abs(F.col("a") - F.col("b")) <= atol + rtol * F.abs("b"))
    return by.select(F.lit("effects_reconcile").alias("name"), "unit", F.coalesce(near, F.lit(False)).alias("ok"), F.concat_ws(" and ", F.col("a").cast("string"), F.col("b").cast("string")).alias("details"))


MANIFEST = "manifest.json"


def freeze(checks: DataFrame, master: DataFrame, path: str, sources: list[str] | None = None, shown: int = 20) -> None:
    """Freeze master at path with a record of the checks and a manifest of digests, unless a check failed or there is none.

    The table is written beside the place first; digests of its files and of the sources and the record follow, and the manifest comes last.
    `frozen` reads nothing without its manifest, so a freeze that broke off is none.  An error if there is a freeze already; what a broken one left is replaced.
    """
    spark = master.sparkSession
    bad = checks.where(~F.col("ok")).orderBy("name", "unit").limit(shown).collect()
    if bad or checks.isEmpty():
        raise ValueError("not frozen: " + ("; ".join(f"{r['name']} of {r['unit']} ({r['details']})" for r in bad) or "no check"))
    fs, place = _at(spark, path)
    if fs.exists(_at(spark, f"{path}/{MANIFEST}")[1]):
        raise FileExistsError(f"{path} is frozen already")
    aside = f"{path}-writing"
    master.write.mode("overwrite").parquet(f"{aside}/master")
    checks.orderBy("name", "unit").write.mode("overwrite").json(f"{aside}/record")
    fs.delete(place, True)
    if not fs.rename(_at(spark, aside)[1], place):
        raise OSError(f"{aside} can't be moved to {path}")
    files = [r.asDict() for p in [f"{path}/master", f"{path}/record", *(sources or [])] for r in file_hashes(spark, p).orderBy("path").collect()]  # one row a file
    with_manifest = json.dumps({"status": "FROZEN", "checks": checks.count(), "files": files}, indent=1)
    out = fs.create(_at(spark, f"{path}/{MANIFEST}")[1], False)
    out.write(bytearray(with_manifest.encode()))
    out.close()


def frozen(spark: SparkSession, path: str) -> DataFrame:
    """The table that is frozen at path; an error without a manifest, or if a file's digest is another one now."""
    fs, manifest = _at(spark, f"{path}/{MANIFEST}")
    if not fs.exists(manifest):
        raise FileNotFoundError(f"{path} is not frozen")
    known = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/{MANIFEST}", wholetext=True).collect()))["files"]
    for folder in sorted({_folder(f["path"]) for f in known}):
        now = {r["path"]: r["sha256"] for r in file_hashes(spark, folder).collect()}
        for f in known:
            if _folder(f["path"]) == folder and now.get(f["path"]) != f["sha256"]:
                raise ValueError(f"{f['path']} is not what was frozen")
    return spark.read.parquet(f"{path}/master")


def _folder(path: str) -> str:
    return path.rsplit("/", 1)[0]


def _at(spark: SparkSession, path: str):
    """The path's file system and the path, of the JVM."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of each file under path, read as a stream, so files can be of any size."""
    with contextlib.suppress(Exception):
        spark.dataSource.register(digests.FileDigests)
    return spark.read.format("file_digests").load(str(path))
