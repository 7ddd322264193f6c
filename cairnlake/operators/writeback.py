"""Writeback suggestions from the evidence of a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import predicates

REASONS = ("inspected", "modified", "git_changed", "stale_graph_source")
DEFAULT_LIMIT, MAX_LIMIT, MAX_CANDIDATES, MAX_RANGE = 6, 20, 5, 80
#: Groups in the order in which they survive a limit.
PRIORITY = ("gotcha", "decision", "invariant", "link")


def clamp_limit(limit: float | None) -> int:
    """Whole, between 0 and 20; anything that isn't a finite number is the default."""
    import math

    if limit is None or not math.isfinite(limit):
        return DEFAULT_LIMIT
    return min(MAX_LIMIT, max(0, math.floor(limit)))


def evidence(branches: dict[str, DataFrame]) -> DataFrame:
    """(file_path, reasons sorted) of the union of evidence branches (reason -> file_path)."""
    rows = None
    for reason, df in branches.items():
        part = df.select(F.regexp_replace(F.trim("file_path"), r"^\./", "").alias("file_path"), F.lit(reason).alias("reason")).where("file_path != ''")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("file_path").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def candidates(found: DataFrame, current: DataFrame) -> DataFrame:
    """Evidence files that exist in the repository, with a range of at most 80 lines and the content hash, by path."""
    from cairnlake.functions.text import n_lines_trimmed, sha256

    safe = found.where(predicates.is_safe_path("file_path") & ~predicates.is_ignored("file_path"))
    there = safe.join(current.select("file_path", "content"), "file_path")
    return there.select("file_path", F.array(F.lit(1), F.greatest(F.lit(1), F.least(n_lines_trimmed("content"), F.lit(MAX_RANGE)))).alias("line_range"), sha256("content").alias("content_hash"), "reasons").orderBy("file_path")


def file_flags(files: DataFrame, *, plan_path: str = predicates.PLAN_PATH) -> DataFrame:
    """One row on the files of a task: numbers by reason and what their paths tell."""
    changed = F.array_contains("reasons", "modified") | F.array_contains("reasons", "git_changed")
    return files.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(changed).alias("n_changed"),
        F.count_if(F.array_contains("reasons", "inspected")).alias("n_inspected"),
        F.coalesce(F.bool_or(changed & F.col("file_path").rlike(plan_path)), F.lit(False)).alias("plan_changed"),
        F.coalesce(F.bool_or(predicates.is_source("file_path")), F.lit(False)).alias("has_source"),
        F.coalesce(F.bool_or(predicates.is_test("file_path")), F.lit(False)).alias("has_test"),
    )


def suggestions(text: Column, n_files: Column, n_changed: Column, n_inspected: Column, plan_changed: Column, has_source: Column, has_test: Column, n_related: Column, n_stale: Column, limit: int) -> Column:
    """array<struct<kind, confidence>> in order of priority, cut to ``limit``."""
    made = {
        "gotcha": ((n_files > 0) & (predicates.mentions_gotcha(text) | (n_stale > 0)), F.when(n_stale > 0, 0.76).otherwise(0.68)),
        "decision": ((n_files > 0) & ((n_changed >= 2) | predicates.mentions_decision(text) | plan_changed), F.when(n_changed > 0, 0.74).otherwise(0.58)),
        "invariant": ((n_files > 0) & (predicates.mentions_invariant(text) | (n_inspected > 0) & has_source | has_test), F.when(n_inspected > 0, 0.72).otherwise(0.64)),
        "link": ((n_related >= 2) & (n_files > 0), F.lit(0.62)),
    }
    rows = [F.when(made[k][0], F.struct(F.lit(k).alias("kind"), made[k][1].alias("confidence"))) for k in PRIORITY]
    return F.slice(F.filter(F.array(*rows), lambda r: r.isNotNull()), 1, limit)
