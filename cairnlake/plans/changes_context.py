"""Impact of a diff: changed files with their symbols, dependants, memories, tests, docs and risk."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairnlake.operators import changes, deps, graph, staleness
from cairnlake.plans.context import refreshed_status
from cairnlake.plans.open_points import open_points
from cairnlake.plans.search import error, ranked
from cairnlake.plans.writeback import suggest_writeback
from cairnlake.sources import git, source_tree
from cairnlake.sources.graph_json import load_graph


def hit_for_file(tables: dict, path: str) -> dict | None:
    """The best chunk of a search for the path: one of the file itself, else the first of all."""
    _, best = ranked(tables["chunks"], path, 5, None)
    rows = best.select("id", "file_path").collect()
    return next((r.asDict() for r in rows if r.file_path == path), rows[0].asDict() if rows else None)


def changes_context(spark: SparkSession, root: str, *, base_ref: str | None = None, include_untracked: bool = True, refresh_index: str = "if_missing", file_limit: int = 20, impact_limit: int = 5, include_writeback: bool = True) -> dict:
    """What the diff touches; the number of changed files counts before the cap on files, deleted ones after it."""
    from cairnlake.plans.search import impact_context

    if not git.is_repository(root):
        return error("NOT_A_REPOSITORY", "changes need a git repository")
    state, _, warnings = refreshed_status(spark, root, refresh_index)
    found = git.changed_files(spark, root, base_ref=base_ref, include_untracked=include_untracked).cache()
    total = found.count()
    rows = found.orderBy("file_path").limit(file_limit)
    index = source_tree.load_index(spark, root)
    g = load_graph(spark, root)
    anchors = graph.anchors(g.nodes)
    symbols = index[0]["files"].select("file_path", "symbols", F.lit(True).alias("indexed")) if index else rows.select("file_path", F.array().cast("array<struct<name:string,kind:string,line:int,exported:boolean>>").alias("symbols"), F.lit(False).alias("indexed")).limit(0)
    joined = rows.join(symbols, "file_path", "left").withColumn("indexed", F.coalesce("indexed", F.lit(False)))
    joined = joined.withColumn("changed_symbols", F.coalesce(changes.symbols_in_ranges(F.col("symbols"), F.col("ranges"), F.col("saw_hunk")), F.array().cast("array<struct<name:string,kind:string,line:int,exported:boolean>>"))).drop("symbols")
    named = anchors.join(g.nodes.select("id", "kind", "name", "summary", "map_pos"), F.col("node_id") == F.col("id")).groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("map_pos", "pos", "id", "name"))).alias("graph_nodes"))
    files = [r.asDict(recursive=True) for r in joined.join(named, "file_path", "left").orderBy("file_path").collect()]
    affected: list[str] = []
    if index:
        tables = index[0]
        edges = deps.import_edges(tables["files"]).cache()
        for f in files:
            hit = hit_for_file(tables, f["file_path"]) if f["indexed"] else None
            f["impact_context"] = hit and impact_context(tables, edges, hit, f["file_path"], impact_limit)
            affected += (f["impact_context"] or {}).get("likely_affected_files", [])
        edges.unpersist()
    for f in files:
        f["known"] = {"index": f["indexed"], "impact": bool(f.get("impact_context")), "memories": bool(f["graph_nodes"])}
    paths = spark.createDataFrame([(p,) for p in {*(f["file_path"] for f in files), *affected}], "file_path string")
    current = source_tree.contents(spark, root, anchors)
    stale = [r.asDict(recursive=True) for r in staleness.stale_nodes_for_files(rows.select("file_path"), anchors, current).collect()]
    repo = git.repo_files(spark, root)
    tests, docs = ([r.asDict() for r in f(paths, repo).collect()] for f in (changes.likely_tests, changes.likely_docs))
    deleted = sum(f["deleted"] for f in files)
    level = spark.range(1).select(changes.risk(F.lit(total), F.lit(len(stale)), F.lit(len(set(affected))), F.lit(deleted))).first()[0]
    written = suggest_writeback(spark, root, modified_files=[f["file_path"] for f in files if not f["deleted"]]) if include_writeback and files else None
    found.unpersist()
    return {
        "ok": True, "base_ref": base_ref, "changed_files": files, "stale_graph_nodes": stale, "likely_affected_files": sorted(set(affected)), "likely_tests": tests, "likely_docs": docs, "writeback": written,
        "summary": {"changed_files": total, "reported_files": len(files), "deleted_files": deleted, "changed_symbols": sum(len(f["changed_symbols"]) for f in files), "affected_files": len(set(affected)), "stale_graph_nodes": len(stale), "risk": level},
        "warnings": warnings, "open": open_points(state, stale_graph_nodes=len(stale), likely_tests=len(tests), likely_docs=len(docs), suggestions=written["total_suggestions"] if written else 0),
    }
