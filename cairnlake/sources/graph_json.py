"""The graph file (one JSON document) as normalised DataFrames, and back."""

from __future__ import annotations

import json
import os
import threading
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake import schemas
from cairnlake.functions.keys import parse_edge_key
from cairnlake.functions.predicates import STATE_DIR, is_valid_node
from cairnlake.functions.text import iso_timestamp
from cairnlake.operators import validate
from cairnlake.operators.intervals import numbered
from cairnlake.sources.lock import locked

GRAPH_PATH_VARIABLE = "CAIRNLAKE_GRAPH_PATH"
SECTIONS = ("nodes", "edges", "topics")


class GraphError(ValueError):
    """The file isn't a graph of this version."""


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    topics: DataFrame


def graph_path(root: str, path: str | None = None) -> str:
    """The argument, else the environment's, else the default place below ``root``."""
    return path or os.environ.get(GRAPH_PATH_VARIABLE) or str(Path(root) / STATE_DIR / "graph.json")


def empty_graph(spark: SparkSession) -> Graph:
    return Graph(*[spark.createDataFrame([], s) for s in (schemas.NODES, schemas.EDGES, schemas.TOPICS)])


def _anchor(s):
    line = lambda i: F.get(s["line_range"], F.lit(i))
    return F.struct(s["file_path"].alias("file_path"), line(0).alias("start_line"), line(1).alias("end_line"), s["content_hash"].alias("content_hash"), s["range_hash"].alias("range_hash"))


def parse_graph(text: DataFrame) -> Graph:
    """A graph from a DataFrame with the document in its one row (column value); raises GraphError on any violation of the schema.

    A row is as large as the document. ``write_lines`` and ``read_lines`` are for graphs beyond one row.
    """
    doc = text.select(F.from_json("value", schemas.GRAPH_FILE, {"mode": "PERMISSIVE"}).alias("g")).select("g.*")
    nodes, edges, topics = (doc.select(F.explode(c).alias("key", "value")) for c in SECTIONS)
    found = doc.agg(F.first("version").alias("v"), F.first("created_at").alias("c")).first()
    return _checked(found, nodes, edges, topics)


def _checked(found, nodes: DataFrame, edges: DataFrame, topics: DataFrame) -> Graph:
    """The graph of (key, value) of each map, nodes in the order of their ids."""
    if found is None or found.v != schemas.GRAPH_VERSION or found.c is None:
        raise GraphError(f"graph version {found.v if found else None} is not {schemas.GRAPH_VERSION}")
    nodes = numbered(nodes.select(F.col("key").alias("id"), F.col("value").alias("n")), "id", "map_pos")
    edges = edges.select("key", F.col("value").alias("e")).withColumn("k", parse_edge_key(F.col("key")))
    topics = topics.select(F.col("key").alias("name"), F.col("value").alias("t"))
    said = lambda what, c: F.concat(F.lit(f"{what} "), F.coalesce(c, F.lit("(not read)"))).alias("what")
    bad = nodes.where(~is_valid_node(F.col("n"), F.col("id"))).select(said("node", F.col("id")))
    bad = bad.union(edges.where("k is null").select(said("edge", F.col("key")))).union(topics.where(F.col("name").isNull() | iso_timestamp("t.created_at").isNull()).select(said("topic", F.col("name"))))
    if faults := [r.what for r in bad.limit(10).collect()]:
        raise GraphError("; ".join(faults))
    node_rows = nodes.select(
        "id", "n.kind", "n.name", "n.summary", F.transform("n.sources", _anchor).alias("sources"), "n.tags", F.coalesce("n.aliases", F.array().cast("array<string>")).alias("aliases"),
        F.coalesce("n.status", F.lit("active")).alias("status"), "n.confidence", iso_timestamp("n.last_verified_at").alias("last_verified_at"), F.col("map_pos").cast("int").alias("map_pos"),
    )
    return Graph(node_rows, edges.select("k.from", "k.to", "k.kind", "e.note"), topics.select("name", iso_timestamp("t.created_at").alias("created_at"), "t.auto_created"))


def write_lines(nodes: DataFrame, edges: DataFrame, topics: DataFrame, folder: str, *, created_at: str) -> None:
    """Writes (key, value) of each map as one JSON document with a member a line, cut into the files of a folder.

    The files in the order of their names are the document's text, so none of them,
    and no task, has more than its part. Keys are unique and not null.
    """
    session = nodes.sparkSession
    fixed = lambda *lines: session.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
    out = fixed(json.dumps({"version": schemas.GRAPH_VERSION, "created_at": created_at})[:-1] + ",")
    for name, members in zip(SECTIONS, (nodes, edges, topics)):
        last = members.agg(F.max("key")).first()[0]
        # to_json of a map quotes the key as well
        line = F.expr("substring(j, 2, length(j) - 2)")
        rows = members.select("key", F.to_json(F.create_map("key", "value")).alias("j"))
        out = out.union(fixed(f'"{name}":{{')).union(rows.where(F.col("key") != F.lit(last)).select(F.concat(line, F.lit(","))))
        out = out.union(rows.where(F.col("key") == F.lit(last)).select(line).coalesce(1)).union(fixed("}" if name == SECTIONS[-1] else "},"))
    out.union(fixed("}")).write.text(folder)


def read_lines(spark: SparkSession, folder: str) -> Graph:
    """The graph of a document as ``write_lines`` lays it out; raises GraphError as ``parse_graph`` does, on other layouts as well.

    Lines are placed by file, split and row; only the three lines that open a map
    are known to the driver, and what a line belongs to follows from their places.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(folder).select("value", place.alias("at"))
    opens = lines.select(F.regexp_extract("value", r'^"(\w+)":\{$', 1).alias("name"), "at").where(F.col("name").isin(*SECTIONS)).groupBy("name").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n")).collect()
    if sorted(r.name for r in opens) != sorted(SECTIONS) or any(r.n > 1 for r in opens):
        raise GraphError("a graph in lines opens each of its maps in one line")
    opens = {r.name: r.at for r in sorted(opens, key=lambda r: r["at"])}
    at = {name: F.struct(F.lit(x.file).alias("file"), F.lit(x.start).alias("start"), F.lit(x.row).alias("row")) for name, x in opens.items()}
    of = F.lit("head")
    for name, x in at.items():
        of = F.when(F.col("at") == x, F.lit("open")).when(F.col("at") > x, F.lit(name)).otherwise(of)
    text = lines.select("value", of.alias("of")).where(F.col("of").isin("head", *SECTIONS) & ~F.col("value").isin("}", "},"))
    found = text.where("of = 'head'").select(F.from_json(F.regexp_replace("value", ",$", "}"), "version int, created_at string").alias("g")).agg(F.first("g.version").alias("v"), F.first("g.created_at").alias("c")).first()

    def members(name: str) -> DataFrame:
        whole = F.concat(F.lit("{"), F.regexp_replace("value", ",$", ""), F.lit("}"))
        return text.where(F.col("of") == name).select(F.explode_outer(F.from_json(whole, schemas.MEMBERS[name])))

    return _checked(found, *map(members, SECTIONS))


def load_graph(spark: SparkSession, root: str, *, path: str | None = None, repair: bool = True) -> Graph:
    """Reads, checks and (in memory) repairs the graph; a missing file is an empty graph."""
    place = graph_path(root, path)
    if not os.path.exists(place):
        return empty_graph(spark)
    graph = parse_graph(spark.read.text(place, wholetext=True))
    if not repair:
        return graph
    return Graph(graph.nodes, *validate.repair(graph.nodes, graph.edges, graph.topics, F.current_timestamp()))


def to_document(graph: Graph) -> dict:
    """The graph as the JSON document's value. A graph of reviewed findings is small by nature; it is one file."""
    stamp = lambda t: t.strftime("%Y-%m-%dT%H:%M:%SZ")
    anchor = lambda s: {"file_path": s.file_path, "line_range": [s.start_line, s.end_line], "content_hash": s.content_hash} | ({"range_hash": s.range_hash} if s.range_hash else {})
    nodes = {r.id: {"kind": r.kind, "name": r.name, "summary": r.summary, "sources": [anchor(s) for s in r.sources], "tags": list(r.tags), "aliases": list(r.aliases), "status": r.status, "confidence": r.confidence, "last_verified_at": stamp(r.last_verified_at)} for r in graph.nodes.toLocalIterator()}
    edges = {f"{r['from']}|{r['to']}|{r.kind}": {"note": r.note} if r.note is not None else {} for r in graph.edges.toLocalIterator()}
    topics = {r.name: {"created_at": stamp(r.created_at), "auto_created": r.auto_created} for r in graph.topics.toLocalIterator()}
    return {"version": schemas.GRAPH_VERSION, "topics": topics, "nodes": nodes, "edges": edges}


def save_graph(graph: Graph, root: str, *, path: str | None = None, created_at: str | None = None) -> str:
    """Writes the document with sorted keys beside its place and renames it under the lock, so readers see the old or the new one.

    A writer that loads, changes and saves holds ``writing`` all the while.
    """
    from datetime import UTC, datetime

    place = Path(graph_path(root, path))
    with locked(place):
        if created_at is None and place.exists():
            created_at = json.loads(place.read_text())["created_at"]
        document = to_document(graph) | {"created_at": created_at or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")}
        draft = place.with_name(f"{place.name}.{os.getpid()}.{threading.get_ident()}.tmp")
        draft.write_text(json.dumps(document, sort_keys=True, indent=2, ensure_ascii=False) + "\n")
        os.replace(draft, place)
    return str(place)


def writing(root: str, path: str | None = None):
    """The lock on the graph file, as a context."""
    return locked(graph_path(root, path))
