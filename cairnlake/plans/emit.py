"""The write path: a session with a topic and a cap, and the checks before a node is written."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake import schemas
from cairnlake.functions.predicates import is_safe_path, is_valid_timestamp
from cairnlake.functions.text import iso_timestamp, n_lines, range_hash, sha256
from cairnlake.operators import collision, graph
from cairnlake.operators.rollup import TURN_CAP
from cairnlake.sources import source_tree
from cairnlake.sources.graph_json import Graph, load_graph, save_graph, writing

REQUEST = "id string, kind string, name string, summary string, sources array<struct<file_path:string,start_line:int,end_line:int,content_hash:string,range_hash:string>>, tags array<string>, aliases array<string>, status string, confidence double, last_verified_at string"


def _now():
    return F.lit(datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def failed(code: str, message: str, **more) -> dict:
    return {"ok": False, "error": {"code": code, "message": message}} | more


@dataclass
class Session:
    """One writer's turn: the active topic and how many nodes it has written."""

    spark: SparkSession
    root: str
    topic: str | None = None
    emitted: int = 0
    log: list[str] = field(default_factory=list)

    def set_active_topic(self, name: str) -> dict:
        """Makes sure that the topic exists, resets the cap and begins a turn."""
        with writing(self.root):
            g = load_graph(self.spark, self.root)
            new = g.topics.where(F.col("name") == name).isEmpty()
            if new:
                topics = graph.ensure_topics(g.topics, self.spark.createDataFrame([(name,)], "name string"), _now(), auto_created=True)
                save_graph(Graph(g.nodes, g.edges, topics), self.root)
        self.topic, self.emitted = name, 0
        return {"ok": True, "auto_created": new}

    def link(self, source: str, target: str, kind: str, note: str | None = None) -> dict:
        if kind not in schemas.EDGE_KINDS:
            return failed("INVALID_KIND", kind)
        with writing(self.root):
            g = load_graph(self.spark, self.root)
            edges, unknown = graph.link(g.nodes, g.edges, self.spark.createDataFrame([(source, target, kind, note)], schemas.EDGES))
            if not unknown.isEmpty():
                return failed("NODE_NOT_FOUND", f"{source} or {target}")
            save_graph(Graph(g.nodes, edges, g.topics), self.root)
            return {"ok": True}

    def emit_node(self, node: dict, *, merge_with: str | None = None, force_new: str | None = None) -> dict:
        """Writes a node unless a check fails: cap, flags, timestamp, anchors, collisions. Only successes count towards the cap."""
        if self.emitted >= TURN_CAP:
            return {"ok": False, "capped": True, "message": f"{TURN_CAP} nodes were written in this turn; begin another topic"}
        if merge_with is not None and force_new is not None:
            return failed("INVALID_FLAGS", "merge_with and force_new exclude each other")
        row = {"tags": [], "aliases": [], "status": "active", "sources": []} | node
        incoming = self.spark.createDataFrame([row], REQUEST)
        if not incoming.select(is_valid_timestamp("last_verified_at", _now())).first()[0]:
            return failed("INVALID_TIMESTAMP", f"not a UTC time that has been: {row['last_verified_at']}")
        anchored, fault = self._anchored(row)
        if fault:
            return failed("INVALID_SOURCE", fault)
        incoming = self.spark.createDataFrame([row | {"sources": anchored}], REQUEST).withColumn("last_verified_at", iso_timestamp("last_verified_at"))
        with writing(self.root):
            return self._write(incoming, merge_with, force_new)

    def _write(self, incoming: DataFrame, merge_with: str | None, force_new: str | None) -> dict:
        g = load_graph(self.spark, self.root)
        if merge_with is not None:
            target = graph.get_node(g.nodes, merge_with).select("id").first()
            if target is None:
                return failed("NODE_NOT_FOUND", merge_with)
            incoming = incoming.withColumn("target", F.lit(target.id))
        elif force_new is None:
            met = collision.find_collisions(incoming, g.nodes).orderBy("rank").collect()
            if met:
                return {"ok": False, "collision": True, "candidates": [{"id": r.candidate, "similarity": r.similarity} for r in met]}
        else:
            incoming = incoming.withColumn("summary", F.concat(F.lit(f"[force_new: {force_new}] "), "summary"))
        nodes = graph.upsert_nodes(g.nodes, incoming, active_topic=self.topic)
        topics = graph.ensure_topics(g.topics, nodes.select(F.explode("tags").alias("name")), _now())
        save_graph(Graph(nodes, g.edges, topics), self.root)
        self.emitted += 1
        return {"ok": True, "id": incoming.select(F.coalesce("target", "id") if merge_with is not None else "id").first()[0]}

    def _anchored(self, row: dict) -> tuple[list[dict], str | None]:
        """(anchors with range hashes, what is wrong): every file must exist, hold the range and have the given hash."""
        if not row["sources"]:
            return [], None
        given = self.spark.createDataFrame([s | {"range_hash": s.get("range_hash"), "o": i} for i, s in enumerate(row["sources"])], "file_path string, start_line int, end_line int, content_hash string, range_hash string, o int")
        current = source_tree.contents(self.spark, self.root, given)
        seen = given.join(current, "file_path", "left").withColumn("safe", is_safe_path("file_path"))
        seen = seen.select("o", "file_path", "start_line", "end_line", "content_hash", "safe", sha256("content").alias("now"), n_lines("content").alias("n"), range_hash("content", "start_line", "end_line").alias("range_hash"))
        out = []
        for r in seen.orderBy("o").collect():
            if not r.safe or r.now is None:
                return [], f"{r.file_path} is no file of the repository"
            if r.now != r.content_hash:
                return [], f"{r.file_path} has another content hash"
            if not 1 <= r.start_line <= r.end_line <= r.n:
                return [], f"{r.file_path} has no lines {r.start_line} to {r.end_line}"
            out.append({k: r[k] for k in ("file_path", "start_line", "end_line", "content_hash", "range_hash")})
        return out, None
