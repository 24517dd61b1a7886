"""Settings, conditions, file discovery and reports: the small things that a driver does around its jobs."""

from __future__ import annotations

import copy
import json
import os
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that name paths and that every file has, and those that it may have; `.` leads into nested settings.
PATHS = ("project_root", "dataset_root", "cleaned_dir", "results_root")
OPTIONAL_PATHS = ("reference_preprocessing_repo", "inference.artifact_sensitivity_mask")


def load(path: str, paths: tuple[str, ...] = PATHS, optional: tuple[str, ...] = OPTIONAL_PATHS) -> dict:
    """A JSON file of settings; relative paths in it are taken from the folder above the file's own.

    A setting of `paths` that is missing is an error; one of `optional` is left out.
    """
    path = os.path.realpath(os.path.expanduser(path))
    with open(path, encoding="utf-8") as f:
        settings = json.load(f)
    base = os.path.dirname(os.path.dirname(path))
    for name in (*paths, *optional):
        *inner, last = name.split(".")
        at = settings
        for k in inner:
            at = at.get(k, {})
        if name in paths and last not in at:
            raise KeyError(f"{path} lacks {name}")
        if at.get(last):
            at[last] = os.path.realpath(os.path.join(base, os.path.expanduser(at[last])))
    return settings


def snapshot(spark: SparkSession, settings: dict, path: str) -> None:
    """The settings as one JSON text at path (any file system that Spark writes), so a run can be told later."""
    report(spark, json.dumps(copy.deepcopy(settings), indent=2).split("\n"), path)


def report(spark: SparkSession, lines: list[str], path: str) -> None:
    """Lines of text, in order, as a table of one text file at path."""
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def conditions(spark: SparkSession, settings: dict, name: str = "eligible_task_bands") -> DataFrame:
    """place, task, band: the conditions in their order."""
    rows = [(i, *x) for i, x in enumerate(settings[name])]
    return spark.createDataFrame(rows, "place int, task string, band string")


def find_one(spark: SparkSession, root: str, name: str) -> str:
    """The path of the one file under root whose name matches the glob; an error if there is none or another."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    found = [r["path"] for r in files.select("path").limit(2).collect()]
    if len(found) != 1:
        raise FileNotFoundError(f"expected one file {name} under {root}, found {'several' if found else 'none'}")
    return found[0]


def sidecar(path: str, ending: str = "_eeg.set", other: str = "_events.tsv") -> str:
    """The name of the file that goes with a recording."""
    folder, name = posixpath.split(path)
    if not name.endswith(ending):
        raise ValueError(f"unexpected file name: {name}")
    return posixpath.join(folder, name[: -len(ending)] + other)


def sidecar_column(path: Column, ending: str = "_eeg.set", other: str = "_events.tsv") -> Column:
    """The same for a column of paths; null where the name ends otherwise."""
    return F.when(path.endswith(ending), F.regexp_replace(path, re.escape(ending) + "$", other))
