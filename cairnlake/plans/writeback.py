"""Writeback suggestions of a repository task."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairnlake.operators import graph, staleness, writeback
from cairnlake.sources import git, source_tree
from cairnlake.sources.graph_json import load_graph

RATIONALES = {
    "gotcha": "The work mentions a fix, a failure, stale memory or a review concern that may surprise the next reader.",
    "decision": "Changed files and the summary may hold a choice that should not be derived again.",
    "invariant": "The evidence points at behaviour, tests or contracts that may encode a rule.",
    "link": "The task matched several nodes; a confirmed relationship is worth an edge.",
}


def repo_path(root: str, path: str) -> str:
    """Relative to ``root`` where it lies below it; others are left for the checks."""
    path = path.strip()
    if not path:
        return ""
    relative = os.path.relpath(os.path.join(os.path.abspath(root), path), os.path.abspath(root)).replace(os.sep, "/")
    return path if relative.startswith("..") else relative


def suggest_writeback(spark: SparkSession, root: str, *, active_topic: str = "", inspected_files=(), modified_files=(), work_summary: str = "", include_git: bool = False, limit: float | None = writeback.DEFAULT_LIMIT) -> dict:
    topic, work = " ".join(active_topic.split()), " ".join(work_summary.split())
    rows = lambda paths: spark.createDataFrame([(repo_path(root, p),) for p in paths], "file_path string")
    question = f"{topic} {work}".strip()
    g = load_graph(spark, root)
    related = graph.lexical_query(g.nodes, question, 5).orderBy(F.desc("score"), "id") if question else g.nodes.limit(0)
    ids = [r.id for r in related.select("id").collect()]
    anchors = graph.anchors(g.nodes.where(F.col("id").isin(ids)))
    stale = staleness.classify(anchors, source_tree.contents(spark, root, anchors)).where("reason is not null")
    stale_ids = [r.node_id for r in stale.select("node_id").distinct().orderBy("node_id").collect()]
    branches = {"inspected": rows(inspected_files), "modified": rows(modified_files), "stale_graph_source": stale.select("file_path")}
    if include_git:
        branches["git_changed"] = git.status_paths(spark, root)
    found = writeback.evidence(branches)
    files = writeback.candidates(found, source_tree.contents(spark, root, found)).cache()
    flags = writeback.file_flags(files)
    cut = writeback.clamp_limit(limit)
    said = flags.select(writeback.suggestions(F.lit(f"{topic} {work}".lower()), *[F.col(c) for c in ("n_files", "n_changed", "n_inspected", "plan_changed", "has_source", "has_test")], F.lit(len(ids)), F.lit(len(stale_ids)), max(cut, 1)).alias("s")).first().s[:cut]
    evidence = [r.asDict(recursive=True) for r in files.collect()]
    files.unpersist()
    changed = [f for f in evidence if {"modified", "git_changed"} & set(f["reasons"])]
    sources = (changed or evidence)[: writeback.MAX_CANDIDATES]
    suggestions = [{"kind": s.kind, "confidence": s.confidence, "rationale": RATIONALES[s.kind], "source_candidates": evidence[: writeback.MAX_CANDIDATES] if s.kind == "link" else sources, "related_node_ids": ids[:5]} for s in said]
    with_reason = lambda reason: [f["file_path"] for f in evidence if reason in f["reasons"]]
    return {
        "ok": True, "active_topic": topic or None, "suggestions": suggestions, "total_suggestions": len(suggestions),
        "evidence": {"inspected_files": with_reason("inspected"), "modified_files": with_reason("modified"), "git_changed_files": with_reason("git_changed"), "work_summary": work or None, "related_node_ids": ids, "stale_graph_node_ids": stale_ids},
        "warnings": [] if suggestions or evidence else ["No file of the repository was given or found, so nothing is suggested."],
    }
