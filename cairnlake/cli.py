"""Command line over the engine; prints JSON. Exit code 0: done, 1: findings or errors, 2: no such thing."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from cairnlake.session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairnlake", description=__doc__)
    p.add_argument("--root", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "index-status", "clear-index", "rollup", "doctor", "validate"):
        sub.add_parser(name)
    for name in ("search", "context", "query-graph"):
        c = sub.add_parser(name)
        c.add_argument("query")
        c.add_argument("--limit", type=int)
        c.add_argument("--mode", default="standard", choices=("compact", "standard", "full"))
    sub.add_parser("changes").add_argument("--base-ref")
    c = sub.add_parser("suggest-writeback")
    c.add_argument("--topic", default="")
    c.add_argument("--summary", default="")
    c.add_argument("--inspected", nargs="*", default=[])
    c.add_argument("--modified", nargs="*", default=[])
    sub.add_parser("show").add_argument("id")
    c = sub.add_parser("deprecate")
    c.add_argument("id")
    c.add_argument("--reason")
    c = sub.add_parser("correct")
    c.add_argument("id")
    for flag in ("name", "summary", "kind"):
        c.add_argument(f"--{flag}")
    c.add_argument("--confidence", type=float)
    for flag in ("add-tag", "remove-tag", "add-alias", "remove-alias"):
        c.add_argument(f"--{flag}", action="append", default=[])
    c = sub.add_parser("link")
    for name in ("source", "target", "kind"):
        c.add_argument(name)
    c.add_argument("--note")
    c = sub.add_parser("report")
    c.add_argument("--check", action="store_true")
    c.add_argument("--stdout", action="store_true")
    return p


def run(spark, a: argparse.Namespace) -> tuple[dict | None, int]:
    from cairnlake.operators import graph
    from cairnlake.plans import changes_context, context, emit, health, report, search, writeback
    from cairnlake.sources import source_tree
    from cairnlake.sources.graph_json import Graph, load_graph, save_graph

    match a.command:
        case "scan":
            return source_tree.build_index(spark, a.root), 0
        case "index-status":
            return source_tree.status(spark, a.root), 0
        case "clear-index":
            return {"cleared": source_tree.clear_index(a.root)}, 0
        case "search":
            out = search.search_source(spark, a.root, a.query, **({"limit": a.limit} if a.limit else {}))
        case "context":
            out = context.query_context(spark, a.root, a.query, mode=a.mode)
        case "query-graph":
            return context.graph_query(spark, a.root, a.query, limit=a.limit or 10), 0
        case "changes":
            out = changes_context.changes_context(spark, a.root, base_ref=a.base_ref)
        case "suggest-writeback":
            out = writeback.suggest_writeback(spark, a.root, active_topic=a.topic, work_summary=a.summary, inspected_files=a.inspected, modified_files=a.modified)
        case "doctor" | "validate":
            out = health.graph_health(spark, a.root)
            return out, 2 if not out["ok"] else int(not out["summary"]["fresh"])
        case "show":
            out = report.show(spark, a.root, a.id)
            return out, 0 if out else 2
        case "rollup":
            return report.weekly(spark, a.root), 0
        case "report":
            out = report.generate_report(spark, a.root, check=a.check, stdout=a.stdout)
        case "link":
            out = emit.Session(spark, a.root).link(a.source, a.target, a.kind, a.note)
        case "deprecate" | "correct":
            g = load_graph(spark, a.root)
            try:
                if a.command == "deprecate":
                    nodes = graph.deprecate(g.nodes, a.id, F.current_timestamp(), a.reason)
                else:
                    nodes = graph.correct(g.nodes, a.id, F.current_timestamp(), name=a.name, summary=a.summary, kind=a.kind, confidence=a.confidence, add_tags=a.add_tag, remove_tags=a.remove_tag, add_aliases=a.add_alias, remove_aliases=a.remove_alias)
            except KeyError:
                return {"ok": False, "error": {"code": "NODE_NOT_FOUND", "message": a.id}}, 2
            save_graph(Graph(nodes, g.edges, g.topics), a.root)
            return {"ok": True}, 0
    return out, int(not out["ok"])


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    out, status = run(local_session(), args)
    print(json.dumps(out, default=str, indent=2, ensure_ascii=False))
    return status


if __name__ == "__main__":
    sys.exit(main())
