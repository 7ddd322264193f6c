import datetime as dt
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnlake import schemas
from cairnlake.functions import similarity
from cairnlake.operators import collision, graph, validate
from cairnlake.plans.query_graph import query_graph
from cairnlake.sources.graph_json import Graph, GraphError, load_graph, save_graph

T = dt.datetime(2026, 4, 28)


def node(i, pos=0, **more):
    return {"id": i, "kind": "concept", "name": i, "summary": "", "sources": [], "tags": [], "aliases": [], "status": "active", "confidence": 0.9, "last_verified_at": T, "map_pos": pos} | more


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [
        node("auth/jwt", 0, name="JWT helper", summary="Signs auth tokens", tags=["auth"], aliases=["token"]),
        node("auth/mw", 1, name="Auth middleware", summary="Checks auth on requests", tags=["auth", "http"]),
        node("bill/old", 2, name="Invoice", summary="auth by invoice", tags=["auth"], status="deprecated", aliases=["auth/mw"]),
    ]
    return spark.createDataFrame(rows, schemas.NODES)


def test_lookup_prefers_ids_to_aliases(nodes):
    assert graph.get_node(nodes, "auth/mw").first().name == "Auth middleware"
    assert graph.get_node(nodes, "token").first().id == "auth/jwt"
    assert graph.get_node(nodes, "nothing").count() == 0


def test_lexical_scores_and_reasons(nodes):
    found = graph.lexical_query(nodes, "auth").collect()
    assert [(r.id, r.score) for r in found] == [("auth/mw", 4.0), ("auth/jwt", 3.0)]
    assert [(r.field, r.score) for r in found[0].match_reasons] == [("tag", 2.0), ("name", 1.0), ("summary", 1.0)]
    assert graph.lexical_query(nodes, "auth auth").first().score == 8.0
    assert graph.lexical_query(nodes, "").count() == 0


def test_merge_keeps_the_better_summary(spark, nodes):
    new = spark.createDataFrame([node("x", name="other", summary="weak", confidence=0.1, tags=["new", "auth"], aliases=["j"]) | {"target": "auth/jwt"}], schemas.NODES + ", target string")
    r = graph.upsert_nodes(nodes, new, active_topic="t").where("id = 'auth/jwt'").first()
    assert (r.name, r.summary, r.confidence, r.tags, r.aliases) == ("JWT helper", "Signs auth tokens", 0.9, ["auth", "new", "t"], ["token", "j"])
    again = graph.upsert_nodes(graph.upsert_nodes(nodes, new), new)
    assert sorted(map(str, again.collect())) == sorted(map(str, graph.upsert_nodes(nodes, new).collect()))


def test_ordered_merge_folds_rows_in_turn(spark, nodes):
    rows = [node("auth/jwt", summary=s, confidence=c) | {"n": i} for i, (s, c) in enumerate([("a", 0.95), ("b", 0.5), ("c", 0.95)])]
    out = graph.upsert_nodes(nodes, spark.createDataFrame(rows, schemas.NODES + ", n int"), order_col="n")
    assert out.where("id = 'auth/jwt'").first().summary == "c"


def test_edges_links_and_repairs(spark, nodes):
    edges = spark.createDataFrame([("auth/jwt", "auth/mw", "calls", "n"), ("auth/jwt", "gone", "calls", None), ("no", "gone", "calls", None)], schemas.EDGES)
    topics = spark.createDataFrame([("auth", T, False)], schemas.TOPICS)
    assert validate.dangling_edges(edges, nodes).count() == 3
    assert {r.topic for r in validate.missing_topics(nodes, topics).collect()} == {"http"}
    kept, filled = validate.repair(nodes, edges, topics, F.current_timestamp())
    assert kept.count() == 1 and {r.name for r in filled.collect()} == {"auth", "http"}
    out, unknown = graph.link(nodes, kept, spark.createDataFrame([("token", "auth/mw", "calls", None), ("token", "nobody", "calls", None)], schemas.EDGES))
    assert [tuple(r) for r in out.collect()] == [("auth/jwt", "auth/mw", "calls", "n")] and unknown.count() == 1
    doubled = nodes.withColumn("aliases", F.array(F.lit("same")))
    assert validate.duplicate_aliases(doubled).first().node_ids == ["auth/jwt", "auth/mw", "bill/old"]


def test_corrections(nodes):
    now = F.lit("2026-05-01").cast("timestamp")
    r = graph.correct(nodes, "token", now, add_tags=["x", "y"], remove_tags=["y", "auth"]).where("id = 'auth/jwt'").first()
    assert r.tags == ["x"] and r.last_verified_at == dt.datetime(2026, 5, 1)
    assert graph.deprecate(nodes, "auth/mw", now, "old").where("id = 'auth/mw'").first().summary == "[deprecated: old] Checks auth on requests"
    with pytest.raises(KeyError):
        graph.deprecate(nodes, "nobody", now)
    with pytest.raises(ValueError):
        graph.correct(nodes, "token", now, confidence=2.0)


def test_quality_ranking_prefers_fresh_memories(spark):
    anchor = lambda h: [{"file_path": "a.ts", "start_line": 1, "end_line": 1, "content_hash": h, "range_hash": None}]
    from hashlib import sha256

    good = "sha256:" + sha256(b"x").hexdigest()
    rows = spark.createDataFrame([node("a", name="auth", sources=anchor("sha256:0")), node("b", name="auth", sources=anchor(good))], schemas.NODES)
    current = spark.createDataFrame([("a.ts", "x")], "file_path string, content string")
    out = query_graph(rows, "auth", F.lit("2026-05-06").cast("timestamp"), current=current).collect()
    assert [(r.id, r.freshness, r.trust) for r in out] == [("b", "fresh", "high"), ("a", "stale", "low")]
    assert {r.freshness for r in query_graph(rows, "auth", F.lit("2026-05-06").cast("timestamp")).collect()} == {"unchecked"}


def dice(a, b):
    g = lambda s: {s.lower()[i : i + 2] for i in range(len(s) - 1)}
    return 1.0 if a == b else 0.0 if min(len(a), len(b)) < 2 else 2 * len(g(a) & g(b)) / (len(g(a)) + len(g(b)))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("abAB", max_size=5), min_size=1, max_size=8))
def test_blocked_collisions_equal_all_pairs(spark, names):
    rows = spark.createDataFrame([node(f"n{i}", i, name=n, aliases=[n[::-1]]) for i, n in enumerate(names)], schemas.NODES)
    for threshold in (0.3, 0.55):
        got = {(r.id, r.candidate, round(r.similarity, 9)) for r in collision.find_collisions(rows, rows, threshold=threshold - 0.1 + 0.1, top=99).collect()}
        want = set()
        for i, a in enumerate(names):
            for j, b in enumerate(names):
                s = 0.5 * max(dice(a, b), dice(a, b[::-1]))
                if i != j and s >= threshold - 0.1 + 0.1:
                    want.add((f"n{i}", f"n{j}", round(s, 9)))
        assert got == want


def test_threshold_from_the_environment(monkeypatch):
    monkeypatch.setenv("COLLISION_THRESHOLD", "0.8")
    assert similarity.threshold() == 0.8
    monkeypatch.setenv("COLLISION_THRESHOLD", "inf")
    assert similarity.threshold() == similarity.DEFAULT_THRESHOLD


def test_graph_file_round_trip(spark, tmp_path, nodes):
    assert load_graph(spark, str(tmp_path)).nodes.count() == 0
    edges = spark.createDataFrame([("auth/jwt", "auth/mw", "calls", "n")], schemas.EDGES)
    topics = spark.createDataFrame([("auth", T, False), ("http", T, True)], schemas.TOPICS)
    place = save_graph(Graph(nodes, edges, topics), str(tmp_path))
    text = open(place).read()
    assert text.endswith("}\n") and list(json.loads(text)) == ["created_at", "edges", "nodes", "topics", "version"]
    back = load_graph(spark, str(tmp_path))
    assert back.nodes.drop("map_pos").exceptAll(nodes.drop("map_pos")).count() == 0 and back.edges.collect() == edges.collect()
    save_graph(back, str(tmp_path))
    assert open(place).read() == text


@pytest.mark.parametrize("change", [{"version": 2}, {"kind": "x"}, {"confidence": 2}, {"line_range": [3, 1]}, {"last_verified_at": "2026-05-01"}, {"key": "a|b"}])
def test_bad_graphs_are_rejected(spark, tmp_path, change):
    n = {"kind": "file", "name": "n", "summary": "s", "sources": [{"file_path": "a", "line_range": change.get("line_range", [1, 2]), "content_hash": "sha256:0"}], "tags": [], "confidence": 0.5, "last_verified_at": "2026-05-01T12:00Z"} | {k: v for k, v in change.items() if k in ("kind", "confidence", "last_verified_at")}
    doc = {"version": change.get("version", 1), "created_at": "2026-05-01T00:00:00Z", "topics": {}, "nodes": {change.get("key", "a"): n}, "edges": {}}
    place = tmp_path / "g.json"
    place.write_text(json.dumps(doc))
    with pytest.raises(GraphError):
        load_graph(spark, str(tmp_path), path=str(place))
