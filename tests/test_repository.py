import json
import subprocess
from hashlib import sha256

import pytest

from cairnlake.plans import changes_context, context, emit, health, report, search, writeback
from cairnlake.sources import metrics_log, source_tree

WELL = "import { rope } from './rope';\n\nexport interface Bucket { litres: number }\n\nexport function drawWater() {\n  return rope;\n}\n"
GARDEN = "import { drawWater } from './well.js';\nexport const waterBeds = async () => {\n  return drawWater();\n};\n"


@pytest.fixture
def repo(tmp_path, monkeypatch):
    """A repository without any git settings of the machine or the user: what they ignore would not be listed."""
    for name, value in (("GIT_CONFIG_GLOBAL", "/dev/null"), ("GIT_CONFIG_SYSTEM", "/dev/null"), ("GIT_CONFIG_NOSYSTEM", "1"), ("XDG_CONFIG_HOME", str(tmp_path / "none"))):
        monkeypatch.setenv(name, value)
    root = tmp_path / "r"
    for path, body in {"src/well.ts": WELL, "src/garden.ts": GARDEN, "node_modules/x.ts": "export const x = 1", "dist/generated.js": "1", "src/a.generated.ts": "1", "README.md": "# r", "test/well.test.ts": "import '../src/well'\n", "_private/p.ts": "let q = x => x\n"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "first")
    return root


def test_index_search_and_status(spark, repo):
    root = str(repo)
    assert search.search_source(spark, root, "x")["error"]["code"] == "INDEX_MISSING"
    stats = source_tree.build_index(spark, root)
    assert (stats["files_indexed"], stats["symbols_indexed"]) == (4, 4)
    assert search.search_source(spark, root, "  ")["error"]["code"] == "EMPTY_QUERY"
    out = search.search_source(spark, root, "drawWater", limit=3, dependency_limit=3, include_impact=True)
    best = out["results"][0]
    assert best["file_path"] == "src/well.ts" and best["chunk_type"] == "function"
    assert best["score_breakdown"]["symbol"] > 0 and out["total_results"] >= 2
    assert [(d["direction"], d["file_path"]) for d in best["dependency_context"]] == [("imported_by", "src/garden.ts"), ("imported_by", "test/well.test.ts")]
    assert best["impact_context"]["target"]["value"] == "drawWater" and "src/garden.ts" in best["impact_context"]["likely_affected_files"]
    assert source_tree.status(spark, root)["fresh"]
    (repo / "src/well.ts").write_text(WELL + "// more\n")
    (repo / "src/garden.ts").unlink()
    (repo / "src/new.ts").write_text("1\n")
    state = source_tree.status(spark, root)
    assert [state[k] for k in ("stale_files", "missing_files", "new_files", "fresh")] == [1, 1, 1, False]
    assert source_tree.clear_index(root) and not source_tree.clear_index(root)


def test_emit_link_context_and_health(spark, repo):
    root = str(repo)
    s = emit.Session(spark, root)
    assert s.set_active_topic("water")["auto_created"]
    anchor = {"file_path": "src/well.ts", "start_line": 5, "end_line": 7, "content_hash": "sha256:" + sha256(WELL.encode()).hexdigest()}
    n = {"id": "water/draw", "kind": "invariant", "name": "Draw water", "summary": "Water is drawn by rope", "sources": [anchor], "confidence": 0.9, "last_verified_at": "2026-05-01T12:00Z"}
    assert s.emit_node(n) == {"ok": True, "id": "water/draw"}
    assert s.emit_node(n | {"last_verified_at": "2999-01-01T00:00:00Z"})["error"]["code"] == "INVALID_TIMESTAMP"
    assert s.emit_node(n | {"sources": [anchor | {"file_path": "../x"}]})["error"]["code"] == "INVALID_SOURCE"
    assert s.emit_node(n | {"id": "water/draw2"}, merge_with="a", force_new="b")["error"]["code"] == "INVALID_FLAGS"
    assert s.emit_node(n | {"id": "water/draw2"})["candidates"][0]["id"] == "water/draw"
    assert s.emit_node(n | {"id": "water/draw2"}, force_new="differs")["ok"]
    assert s.link("water/draw", "water/draw2", "derived_from")["ok"]
    assert s.link("water/draw", "nobody", "calls")["error"]["code"] == "NODE_NOT_FOUND"
    assert len(report.show(spark, root, "water/draw")["edges"]) == 1
    out = context.query_context(spark, root, "draw water")
    assert {n["id"] for n in out["graph"]["nodes"]} == {"water/draw", "water/draw2"} and out["source_search"]["ok"]
    assert out["related_nodes"] and not out["graph"]["stale_sources"]
    assert health.graph_health(spark, root)["summary"]["fresh"]
    (repo / "src/well.ts").write_text(WELL.replace("return rope", "return null"))
    bad = health.graph_health(spark, root, issue_limit=1)
    assert (bad["summary"]["anchor_changed"], bad["summary"]["truncated_stale_sources"], len(bad["issues"]["stale_sources"])) == (2, True, 1)
    diff = changes_context.changes_context(spark, root, refresh_index="if_stale")
    # The graph itself is a file of the repository like any other; only the index and the generated report are hidden.
    assert [f["file_path"] for f in diff["changed_files"]] == [".cairnlake/graph.json", "src/well.ts"] and diff["summary"]["stale_graph_nodes"] == 2
    assert [t["file_path"] for t in diff["likely_tests"]] == ["test/well.test.ts"] and diff["summary"]["risk"] in ("medium", "high")
    s.emitted = emit.TURN_CAP
    assert s.emit_node(n)["capped"]


def test_writeback_report_and_metrics(spark, repo, monkeypatch):
    root = str(repo)
    out = writeback.suggest_writeback(spark, root, modified_files=["./src/well.ts", str(repo / "src/garden.ts"), "../outside", "dist/generated.js"], work_summary="fix a bug")
    assert out["evidence"]["modified_files"] == ["src/garden.ts", "src/well.ts"]
    assert [s["kind"] for s in out["suggestions"]] == ["gotcha", "decision"]
    source_tree.build_index(spark, root)
    assert not report.generate_report(spark, root, check=True)["ok"]
    report.generate_report(spark, root)
    assert report.generate_report(spark, root, check=True)["ok"]
    turn = {"topic": "t", "ts": None, "queries": 1, "results_returned": 0, "nodes_emitted": 2, "collisions_detected": 1, "cap_hit": True, "stale_rechecks": 0, "links_made": 0, "validator_repairs": 0}
    import datetime as dt

    assert metrics_log.record_turn(spark, root, turn | {"ts": dt.datetime.now()})
    row = report.weekly(spark, root)
    assert (row["total_emissions"], row["total_collisions"], row["cap_hits"], row["total_nodes"]) == (2, 1, 1, 0)
    monkeypatch.setenv(metrics_log.OPT_OUT, "0")
    assert report.weekly(spark, root) is None and not metrics_log.record_turn(spark, root, turn)


def test_cli(spark, repo, capsys, monkeypatch):
    from cairnlake import cli

    monkeypatch.setattr(cli, "local_session", lambda: spark)
    assert cli.main(["--root", str(repo), "scan"]) == 0 and json.loads(capsys.readouterr().out)["files_indexed"] == 4
    assert cli.main(["--root", str(repo), "search", "beds"]) == 0
    assert cli.main(["--root", str(repo), "show", "nobody"]) == 2
    assert cli.main(["--root", str(repo), "doctor"]) == 0


def test_a_lock_is_held_given_back_and_left_behind(tmp_path):
    import os
    import threading

    from cairnlake.sources.lock import locked

    place, said = tmp_path / "deep" / "file.json", []
    with locked(place):
        with locked(place):  # again in the same thread
            pass
        assert os.path.exists(f"{place}.lock")

        def other():
            try:
                with locked(place, wait=0.2):
                    said.append("in")
            except TimeoutError:
                said.append("late")

        t = threading.Thread(target=other)
        t.start()
        t.join()
    assert said == ["late"] and not os.path.exists(f"{place}.lock")
    open(f"{place}.lock", "w").close()
    os.utime(f"{place}.lock", (1, 1))
    with locked(place, wait=0.2):
        said.append("taken over")
    assert said[-1] == "taken over"


def test_writers_at_once_lose_nothing(spark, repo):
    from concurrent.futures import ThreadPoolExecutor

    from cairnlake.sources.graph_json import load_graph

    root = str(repo)
    node = lambda i: {"id": f"n{i}", "kind": "concept", "name": f"{'abcd'[i] * 8}", "summary": "s", "confidence": 0.5, "last_verified_at": "2026-05-01T12:00Z"}
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda i: emit.Session(spark, root).emit_node(node(i)), range(4)))
    assert all(d["ok"] for d in done) and sorted(r.id for r in load_graph(spark, root).nodes.collect()) == ["n0", "n1", "n2", "n3"]
