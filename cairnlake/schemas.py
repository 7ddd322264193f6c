"""Schemas of the tables and closed domains of their columns."""

from __future__ import annotations

# The closed domains.
NODE_KINDS = ("file", "symbol", "package", "integration", "concept", "flow", "decision", "invariant", "gotcha")
KNOWLEDGE_KINDS = ("decision", "invariant", "gotcha")
NODE_STATUSES = ("active", "deprecated")
EDGE_KINDS = ("imports", "calls", "depends_on", "implements", "replaces", "contradicts", "derived_from", "mirrors")
SYMBOL_KINDS = ("class", "const", "enum", "function", "interface", "type")
CHUNK_TYPES = (*SYMBOL_KINDS, "file", "mixed")
STALE_REASONS = ("anchor_changed", "changed", "missing", "unsafe_path", "read_error")
CHANGE_STATUSES = ("added", "modified", "deleted", "renamed", "untracked")
GRAPH_VERSION = INDEX_VERSION = METRICS_VERSION = 1


# Schemas are DDL text, so that importing them needs no session.
ANCHOR = "struct<file_path:string,start_line:int,end_line:int,content_hash:string,range_hash:string>"
NODES = (f"id string, kind string, name string, summary string, sources array<{ANCHOR}>, tags array<string>, aliases array<string>, status string, confidence double, last_verified_at timestamp, map_pos int")
ANCHORS = ("node_id string, pos int, file_path string, start_line int, end_line int, content_hash string, range_hash string")
EDGES = ("`from` string, `to` string, kind string, note string")
TOPICS = ("name string, created_at timestamp, auto_created boolean")
SYMBOL = "struct<name:string,kind:string,line:int,exported:boolean>"
IMPORT = "struct<module:string,line:int>"
FILES = (f"file_path string, language string, size_bytes long, mtime_ms long, line_count int, content_hash string, imports array<{IMPORT}>, exports array<string>, symbols array<{SYMBOL}>")
CHUNKS = (f"id string, file_path string, language string, start_line int, end_line int, chunk_type string, symbols array<{SYMBOL}>, imports array<{IMPORT}>, exports array<string>, content string, content_hash string")
TURNS = ("topic string, ts timestamp, queries int, results_returned int, nodes_emitted int, collisions_detected int, cap_hit boolean, stale_rechecks int, links_made int, validator_repairs int")
ROLLUPS = ("week_of date, total_nodes long, verified_pct_7d double, knowledge_kind_ratio double, total_emissions long, total_collisions long, cap_hits long")
LISTING = ("file_path string, language string, size_bytes long, mtime_ms long, content string")

#: The maps of the graph file; ids are keys of maps, so the schema is never inferred.
MEMBERS = {
    "topics": "map<string, struct<created_at:string,auto_created:boolean>>",
    "nodes": "map<string, struct<kind:string,name:string,summary:string,sources:array<struct<file_path:string,line_range:array<int>,content_hash:string,range_hash:string>>,tags:array<string>,aliases:array<string>,status:string,confidence:double,last_verified_at:string>>",
    "edges": "map<string, struct<note:string>>",
}
GRAPH_FILE = "version int, created_at string, " + ", ".join(f"{k} {v}" for k, v in MEMBERS.items())
