"""Git as a source: lines of its output as DataFrames. Only the command runs on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.functions.text import n_lines
from cairnlake.operators import changes
from cairnlake.sources.source_tree import contents


def run(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, "-c", "core.quotepath=off", *args], check=True, capture_output=True, text=True, errors="replace").stdout


def is_repository(root: str) -> bool:
    try:
        return run(root, "rev-parse", "--is-inside-work-tree").strip() == "true"
    except (subprocess.CalledProcessError, FileNotFoundError):
        return False


def lines(spark: SparkSession, text: str, separator: str = "\n") -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(text.split(separator))], "ord int, line string")


def repo_files(spark: SparkSession, root: str) -> DataFrame:
    """Tracked files, sorted; none if git fails."""
    try:
        names = sorted(filter(None, run(root, "ls-files").split("\n")))
    except (subprocess.CalledProcessError, FileNotFoundError):
        names = []
    return spark.createDataFrame([(n,) for n in names], "file_path string")


def untracked_files(spark: SparkSession, root: str) -> DataFrame:
    names = list(filter(None, run(root, "ls-files", "--others", "--exclude-standard").split("\n")))
    return spark.createDataFrame([(n,) for n in names], "file_path string")


def status_paths(spark: SparkSession, root: str) -> DataFrame:
    """Paths of the porcelain status."""
    return changes.porcelain(lines(spark, run(root, "status", "--porcelain", "-z"), "\0").withColumnRenamed("line", "record")).select("file_path")


def changed_files(spark: SparkSession, root: str, *, base_ref: str | None = None, include_untracked: bool = True) -> DataFrame:
    """Changed files with flags and ranges; against ``base_ref`` only, or staged, unstaged and untracked ones."""
    sources = {"base": [f"{base_ref}...HEAD"]} if base_ref else {"staged": ["--cached"], "unstaged": []}
    statuses, ranges = None, None
    for name, args in sources.items():
        s = changes.name_status(lines(spark, run(root, "diff", "--name-status", *args)), name)
        r = changes.hunk_ranges(lines(spark, run(root, "diff", "--unified=0", "--no-color", *args)), name)
        statuses, ranges = (s, r) if statuses is None else (statuses.unionByName(s), ranges.unionByName(r))
    if include_untracked and not base_ref:
        new = untracked_files(spark, root)
        whole = contents(spark, root, new).select("file_path", F.lit(1).alias("start_line"), F.greatest(F.lit(1), n_lines("content")).alias("end_line"), F.lit("untracked").alias("source"))
        statuses = statuses.unionByName(new.select("file_path", F.lit("untracked").alias("status"), F.lit("untracked").alias("source")))
        found = changes.changed_files(statuses, ranges.unionByName(whole))
        return found.withColumn("saw_hunk", F.col("saw_hunk") & ~F.col("untracked"))
    return changes.changed_files(statuses, ranges)
