"""Registry of the engine's own queries: name -> function, name -> SQL for DuckDB."""

from __future__ import annotations

from cairnlake.queries import changes, graph, repository, retrieval, sources

_ALL = retrieval.REGISTRY | graph.REGISTRY | changes.REGISTRY | sources.REGISTRY | repository.REGISTRY

QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
