"""Source search over the index of a repository: ranking, diversification, dependency and impact context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.functions.text import preview, rounded
from cairnlake.operators import deps, graph, retrieval
from cairnlake.sources import source_tree
from cairnlake.sources.graph_json import GraphError, load_graph

DEFAULTS = {"limit": 5, "max_content_chars": 2400, "dependency_limit": 0, "dependency_content_chars": 600, "include_impact": False, "impact_limit": 5}
FIELDS = ("bm25", "content", "export", "import", "path", "related_graph_node", "symbol")


def related_by_file(spark: SparkSession, root: str) -> DataFrame | None:
    """Nodes by anchored file; none for a graph that can't be read."""
    try:
        g = load_graph(spark, root)
    except GraphError:
        return None
    return retrieval.related_nodes(g.nodes, graph.anchors(g.nodes))


def ranked(chunks: DataFrame, query: str, limit: int, related: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(all scored chunks, the diversified best with their reasons); the texts of the best only are fetched again."""
    order = [F.desc("score"), F.col("file_path"), F.col("start_line")]
    scored = retrieval.rank_chunks(chunks, query, related, keep=["id", "file_path", "start_line"])
    best = retrieval.diversified(scored, limit, file_col="file_path", order=order)
    return scored, retrieval.with_reasons(best, chunks, query, key="id").orderBy("tier", *order)


def error(code: str, message: str) -> dict:
    return {"ok": False, "error": {"code": code, "message": message}}


def search_source(spark: SparkSession, root: str, query: str, **options) -> dict:
    """The best chunks for a query; an empty query or a missing or invalid index is an error, a stale one a warning."""
    o = DEFAULTS | options
    query = query.strip()
    if not query:
        return error("EMPTY_QUERY", "the query is empty")
    try:
        found = source_tree.load_index(spark, root)
    except ValueError as e:
        return error("INDEX_INVALID", str(e))
    if found is None:
        return error("INDEX_MISSING", "build the index first")
    tables, _ = found
    state = source_tree.status(spark, root)
    scored, best = ranked(tables["chunks"], query, o["limit"], related_by_file(spark, root))
    total = scored.count()
    shown = best.withColumn("content", preview("content", o["max_content_chars"])).withColumn("score", rounded("score"))
    shown = shown.withColumn("related", F.slice("related", 1, 3)).withColumn("score_breakdown", F.struct(*[rounded(f"score_breakdown.{f}").alias(f) for f in FIELDS]))
    results = [r.asDict(recursive=True) for r in shown.select("id", "file_path", "start_line", "end_line", "chunk_type", "symbols", "score", "score_breakdown", "match_reasons", F.col("related").alias("related_nodes"), "content").collect()]
    if o["dependency_limit"] or o["include_impact"]:
        add_context(spark, tables, results, query, o)
    warnings = [] if state["fresh"] else ["the source index is stale; refresh it before relying on the results"]
    return {"ok": True, "query": query, "total_results": total, "results": results, "status": state, "warnings": warnings}


def add_context(spark: SparkSession, tables: dict[str, DataFrame], results: list[dict], query: str, o: dict) -> None:
    """Adds dependency and impact context to at most ``limit`` results; the import edges are resolved once."""
    edges = deps.import_edges(tables["files"]).cache()
    try:
        if o["dependency_limit"] and results:
            targets = spark.createDataFrame([(p,) for p in {r["file_path"] for r in results}], "file_path string")
            rows = deps.dependency_context(edges, targets, o["dependency_limit"]).join(deps.file_preview(tables["chunks"], o["dependency_content_chars"]), "file_path", "left")
            by_target: dict[str, list] = {}
            for r in rows.orderBy("target", "rank").collect():
                by_target.setdefault(r.target, []).append({k: r[k] for k in ("direction", "file_path", "module", "import_line", "content_preview")})
            for r in results:
                r["dependency_context"] = by_target.get(r["file_path"], [])
        if o["include_impact"]:
            for r in results:
                r["impact_context"] = impact_context(tables, edges, r, query, o["impact_limit"])
    finally:
        edges.unpersist()


def impact_context(tables: dict[str, DataFrame], edges: DataFrame, hit: dict, query: str, limit: int) -> dict:
    """What a change of the hit's symbol, or of its file, may touch."""
    own = tables["chunks"].where(F.col("id") == hit["id"]).select("file_path", F.col("symbols").alias("own"))
    meant = own.join(tables["files"].select("file_path", F.col("symbols").alias("all")), "file_path").select(deps.target_symbol(F.col("own"), F.col("all"), query).alias("s")).first()
    symbol = meant.s.asDict() if meant and meant.s else None
    found = {k: [r.asDict() for r in df.collect()] for k, df in deps.impact(tables["files"], tables["chunks"], edges, hit["file_path"], symbol and symbol["name"], limit).items()}
    ambiguous = len(found["definitions"]) > 1
    warnings = [f'Symbol "{symbol["name"]}" has several indexed definitions; look at each before editing.'] if ambiguous else []
    if found["references"]:
        warnings.append("References are lexical matches, not a call graph.")
    target = {"type": "symbol" if symbol else "file", "value": symbol["name"] if symbol else hit["file_path"], "file_path": hit["file_path"], "ambiguous": ambiguous, "matched_symbol": symbol}
    return {"target": target, "definitions": found["definitions"], "imports": found["imports"], "imported_by": found["imported_by"], "approximate_references": found["references"], "likely_affected_files": [r["file_path"] for r in found["affected"]], "warnings": warnings}
