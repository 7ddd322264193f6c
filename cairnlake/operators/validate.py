"""Graph validation and repair: dangling edges, duplicate aliases, tags without topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.keys import edge_key
from cairnlake.operators.graph import ensure_topics


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_key, missing_endpoint): a row for each missing end."""
    ends = edges.select(edge_key(F.col("from"), F.col("to"), F.col("kind")).alias("edge_key"), F.explode(F.array("from", "to")).alias("missing_endpoint"))
    return ends.join(nodes.select(F.col("id").alias("missing_endpoint")), "missing_endpoint", "left_anti").select("edge_key", "missing_endpoint")


def duplicate_aliases(nodes: DataFrame) -> DataFrame:
    """(alias, node_ids in document order) with two owners or more; deprecated nodes and repeats in one node count."""
    owned = nodes.select("id", "map_pos", F.explode("aliases").alias("alias"))
    grouped = owned.groupBy("alias").agg(F.array_sort(F.collect_list(F.struct("map_pos", "id"))).alias("o")).where(F.size("o") > 1)
    return grouped.select("alias", F.transform("o", lambda x: x["id"]).alias("node_ids"))


def missing_topics(nodes: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, node_id) for each tag, and each time it is listed, that has no topic."""
    tags = nodes.select(F.explode("tags").alias("topic"), F.col("id").alias("node_id"))
    return tags.join(topics.select(F.col("name").alias("topic")), "topic", "left_anti")


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select(F.col("id").alias("__id"))
    return edges.join(ids, edges["from"] == ids["__id"], "left_semi").join(ids, edges["to"] == ids["__id"], "left_semi")


def repair(nodes: DataFrame, edges: DataFrame, topics: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(edges without dangling ones, topics with the missing ones); repairing twice changes nothing more."""
    absent = missing_topics(nodes, topics).select(F.col("topic").alias("name"))
    return without_dangling(edges, nodes), ensure_topics(topics, absent, now, auto_created=True)


def report(nodes: DataFrame, edges: DataFrame, topics: DataFrame) -> DataFrame:
    """One row: numbers of repairs and warnings."""
    counts = dangling_edges(edges, nodes).select(F.lit("dangling_edges").alias("k")).union(missing_topics(nodes, topics).select(F.lit("missing_topics"))).union(duplicate_aliases(nodes).select(F.lit("duplicate_aliases")))
    n = lambda k: F.count_if(F.col("k") == k).alias(k)
    return counts.agg(n("dangling_edges"), n("missing_topics"), n("duplicate_aliases")).withColumn("repairs", F.col("dangling_edges") + F.col("missing_topics"))
