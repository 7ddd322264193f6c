"""Graph health: validation before repairs, staleness of all anchors, and what to look at."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairnlake.operators import graph, staleness, validate
from cairnlake.schemas import STALE_REASONS
from cairnlake.sources import source_tree
from cairnlake.sources.graph_json import Graph, GraphError, load_graph

def graph_health(spark: SparkSession, root: str, *, include_deprecated: bool = False, issue_limit: int = 50) -> dict:
    """Counts, issues within one shared budget, and what asks for a look (by count). Validation is of the graph as it is stored, edges are counted after repair."""
    try:
        raw = load_graph(spark, root, repair=False)
    except GraphError as e:
        return {"ok": False, "error": {"code": "GRAPH_HEALTH_FAILED", "message": str(e)}}
    fixed = Graph(raw.nodes, *validate.repair(raw.nodes, raw.edges, raw.topics, F.current_timestamp()))
    dangling = [r.asDict() for r in validate.dangling_edges(raw.edges, raw.nodes).collect()]
    absent = [r.asDict() for r in validate.missing_topics(raw.nodes, raw.topics).collect()]
    aliases = [r.asDict() for r in validate.duplicate_aliases(raw.nodes).collect()]
    checked = graph.list_nodes(raw.nodes, include_deprecated=include_deprecated)
    anchors = graph.anchors(checked)
    status = staleness.classify(anchors, source_tree.contents(spark, root, anchors)).cache()
    count = lambda r: F.count_if(F.col("reason") == r).alias(r)
    sums = status.agg(F.count(F.lit(1)).alias("checked_sources"), F.count("reason").alias("stale_sources"), F.count_if("range_fresh").alias("range_fresh_sources"), *[count(r) for r in STALE_REASONS]).first().asDict()
    listed = [r.asDict() for r in status.where("reason is not null").select("node_id", "pos", "file_path", "start_line", "end_line", "reason").orderBy("node_id", "pos").limit(issue_limit).collect()]
    status.unpersist()
    nodes = raw.nodes.agg(F.count(F.lit(1)).alias("total_nodes"), F.count_if(F.col("status") == "active").alias("active_nodes")).first().asDict()
    repairs = len(dangling) + len(absent)
    fresh = not (repairs or aliases or sums["stale_sources"])
    summary = nodes | sums | {
        "deprecated_nodes": nodes["total_nodes"] - nodes["active_nodes"], "checked_nodes": nodes["total_nodes"] if include_deprecated else nodes["active_nodes"], "total_edges": fixed.edges.count(),
        "duplicate_aliases": len(aliases), "validator_repairs": repairs, "issue_limit": issue_limit, "reported_stale_sources": len(listed), "truncated_stale_sources": sums["stale_sources"] > issue_limit, "fresh": fresh,
    }
    wrong = {"duplicate_aliases": len(aliases), "repairs": repairs} | {r: sums[r] for r in STALE_REASONS}
    issues = {"duplicate_aliases": aliases, "dangling_edges": dangling, "missing_topics": absent, "stale_sources": listed} | {f"{r}_sources": [s for s in listed if s["reason"] == r] for r in STALE_REASONS}
    return {"ok": True, "summary": summary, "issues": issues, "to_check": {k: n for k, n in wrong.items() if n}}
