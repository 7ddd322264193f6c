"""Staleness of source anchors and of the source index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.predicates import is_safe_path
from cairnlake.functions.text import range_hash, sha256


def reason(unsafe: Column, missing: Column, unreadable: Column, range_expected: Column, range_now: Column, file_expected: Column, file_now: Column) -> Column:
    """The first cause that applies; null is not stale."""
    return (
        F.when(unsafe, "unsafe_path")
        .when(missing, "missing")
        .when(unreadable, "read_error")
        .when(range_expected.isNotNull() & (range_expected != range_now), "anchor_changed")
        .when(range_expected.isNull() & (file_expected != file_now), "changed")
    )


def classify(anchors: DataFrame, current: DataFrame) -> DataFrame:
    """Anchors with ``reason`` (null: fresh) and ``range_fresh`` (the file changed, the cited range didn't).

    ``current`` has file_path and content of the files there are; a null content
    could not be read. File hashes are taken once a file, ranges once an anchor.
    """
    now = current.select("file_path", "content", sha256("content").alias("hash_now"), F.lit(True).alias("there"))
    rows = anchors.join(now, "file_path", "left")
    rows = rows.withColumn("range_now", F.when(F.col("range_hash").isNotNull(), range_hash("content", "start_line", "end_line")))
    why = reason(~is_safe_path("file_path"), F.col("there").isNull(), F.col("content").isNull(), F.col("range_hash"), F.col("range_now"), F.col("content_hash"), F.col("hash_now"))
    rows = rows.withColumn("reason", why)
    fresh = F.col("reason").isNull() & F.col("range_hash").isNotNull() & (F.col("content_hash") != F.col("hash_now"))
    return rows.withColumn("range_fresh", F.coalesce(fresh, F.lit(False))).drop("content", "hash_now", "there", "range_now")


def stale_counts(status: DataFrame) -> DataFrame:
    """node_id, n_sources, stale."""
    return status.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_sources"), F.count_if(F.col("reason").isNotNull()).alias("stale"))


def for_nodes(status: DataFrame, ids: DataFrame, *, id_col: str = "id") -> DataFrame:
    """The part of a staleness report that belongs to the given nodes."""
    return status.join(ids.select(F.col(id_col).alias("node_id")), "node_id", "left_semi")


def stale_nodes_for_files(changed: DataFrame, anchors: DataFrame, current: DataFrame) -> DataFrame:
    """(node_id, stale_sources): nodes anchored to a changed file with a stale source in any of their files."""
    touched = anchors.join(changed.select("file_path"), "file_path", "left_semi").select("node_id").distinct()
    status = classify(anchors.join(touched, "node_id", "left_semi"), current).where("reason is not null")
    return status.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("file_path", "start_line", "reason"))).alias("stale_sources")).orderBy("node_id")


def index_status(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """One row: stale, missing and new files. Equal times spare the hash; other sizes are stale at once.

    Both sides have file_path, size_bytes, mtime_ms and content_hash.
    """
    old = indexed.select("file_path", F.struct("size_bytes", "mtime_ms", "content_hash").alias("o"))
    new = current.select("file_path", F.struct("size_bytes", "mtime_ms", "content_hash").alias("n"))
    both = old.join(new, "file_path", "full_outer")
    o, n = F.col("o"), F.col("n")
    state = F.when(n.isNull(), "missing").when(o.isNull(), "new").when(o["size_bytes"] != n["size_bytes"], "stale").when(o["mtime_ms"] == n["mtime_ms"], "same").when(o["content_hash"] != n["content_hash"], "stale").otherwise("same")
    count = lambda s: F.count_if(F.col("state") == s).alias(f"{s}_files")
    counted = both.select(state.alias("state")).agg(count("stale"), count("missing"), count("new"))
    return counted.withColumn("fresh", (F.col("stale_files") == 0) & (F.col("missing_files") == 0) & (F.col("new_files") == 0))
