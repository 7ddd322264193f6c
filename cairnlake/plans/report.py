"""The generated orientation report of a repository, and the views of single nodes and weeks."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairnlake.functions.predicates import STATE_DIR
from cairnlake.operators import code, graph, rollup
from cairnlake.schemas import KNOWLEDGE_KINDS
from cairnlake.sources import metrics_log, source_tree
from cairnlake.sources.graph_json import load_graph


def render(spark: SparkSession, root: str) -> str:
    """The report's text: snapshot, areas, exported symbols and memory highlights, with a hash of what it was made from."""
    state, found, g = source_tree.status(spark, root), source_tree.load_index(spark, root), load_graph(spark, root)
    area_rows = code.areas(found[0]["files"], F.col("file_path"), F.size("symbols")).collect() if found else []
    exported = code.export_highlights(found[0]["files"]).collect() if found else []
    memory = graph.knowledge_nodes(g.nodes, KNOWLEDGE_KINDS).select("id", "kind", "name").collect()
    made_from = {"source": state.get("updated_at"), "files": state["files_indexed"], "symbols": state["symbols_indexed"], "memory": [m.id for m in memory]}
    digest = hashlib.sha256(json.dumps(made_from, sort_keys=True).encode()).hexdigest()
    listed = lambda rows, say, none: "\n".join(f"- {say(r)}" for r in rows) or f"- {none}"
    return "\n\n".join(
        [
            f"# Repository context: {Path(root).resolve().name}\n\n<!-- generated hash=sha256:{digest} -->",
            "Generated from the source index and the graph; orientation, not proof.",
            "## Source index\n\n" + "\n".join(f"- {k}: {state.get(k, 'none')}" for k in ("indexed", "fresh", "updated_at", "files_indexed", "chunks_indexed", "symbols_indexed")),
            "## Areas\n\n" + listed(area_rows, lambda r: f"{r.name}: {r.files} files, {r.symbols} symbols", "none indexed"),
            "## Exported symbols\n\n" + listed(exported, lambda r: f"{r.name} ({r.kind}) in {r.file_path}", "none indexed"),
            "## Memory\n\n" + listed(memory, lambda r: f"{r.id} ({r.kind}): {r.name}", "none yet"),
        ]
    ) + "\n"


def generate_report(spark: SparkSession, root: str, *, output: str | None = None, check: bool = False, stdout: bool = False) -> dict:
    """Writes the report, or checks that it is current, or only returns it."""
    place = Path(output or Path(root) / STATE_DIR / "skills" / "context.md")
    body = render(spark, root)
    current = place.exists() and place.read_text() == body
    if not check and not stdout:
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(body)
        current = True
    return {"ok": current or not check, "path": str(place), "current": current, "body": body if stdout else None}


def show(spark: SparkSession, root: str, key: str) -> dict | None:
    """A node by id or alias with its incident edges."""
    g = load_graph(spark, root)
    node = graph.get_node(g.nodes, key).first()
    return node and {"node": node.asDict(recursive=True), "edges": [r.asDict() for r in graph.incident_edges(g.edges, node.id).collect()]}


def weekly(spark: SparkSession, root: str) -> dict | None:
    """Computes and stores this week's rollup; None if telemetry is off."""
    if metrics_log.is_disabled():
        return None
    with metrics_log.writing(root):
        tables = metrics_log.load(spark, root)
        fresh = rollup.weekly_rollup(load_graph(spark, root).nodes, tables["turns"], F.current_timestamp())
        row = fresh.first().asDict()
        metrics_log.save(root, tables | {"rollups": rollup.upsert_rollup(tables["rollups"], fresh)})
    return row
