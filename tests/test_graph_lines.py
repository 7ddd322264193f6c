"""A graph document with a member a line, in the files of a folder."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cairnlake import schemas
from cairnlake.operators.intervals import numbered
from cairnlake.queries import sources
from cairnlake.sources import graph_json

STAMP = "2024-01-02T03:04:05Z"


def members(spark, name, rows):
    kind = schemas.MEMBERS[name].removeprefix("map<string, ").removesuffix(">")
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()], "key string, j string").repartition(3).select("key", F.from_json("j", kind).alias("value"))


def parts(n):
    node = {"kind": "flow", "name": 'odd "},\n{', "summary": "s", "sources": [], "tags": ["a,"], "confidence": 0.5, "last_verified_at": STAMP}
    return {"nodes": {"nodes": node, 'quo"te': node} | {f"n{i}": node | {"name": f"name {i}"} for i in range(n)}, "edges": {"n1|n2|calls": {"note": "é"}, "n2|n1|calls": {}}, "topics": {"topics": {"created_at": STAMP, "auto_created": True}}}


@pytest.mark.parametrize("split", ["134217728", "700"])
def test_lines_are_one_document_and_parse_as_it(spark, tmp_path, split):
    rows, folder = parts(40), f"{tmp_path}/graph.json"
    graph_json.write_lines(*[members(spark, s, rows[s]) for s in graph_json.SECTIONS], folder, created_at=STAMP)
    whole = "".join(p.read_text() for p in sorted(Path(folder).glob("part-*")))
    assert {k: set(v) for k, v in json.loads(whole).items() if isinstance(v, dict)} == {k: set(v) for k, v in rows.items()}
    want = graph_json.parse_graph(spark.createDataFrame([(whole,)], "value string"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)  # lines of one file in several splits
    try:
        got = graph_json.read_lines(spark, folder)
        for a, b in zip((got.nodes, got.edges, got.topics), (want.nodes, want.edges, want.topics)):
            assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("line", ['"bad":{"kind":"idea"},', '"half":{"kind"', '"edges":{'])
def test_faulty_lines_are_errors(spark, tmp_path, line):
    rows, folder = parts(3), f"{tmp_path}/graph.json"
    graph_json.write_lines(*[members(spark, s, rows[s]) for s in graph_json.SECTIONS], folder, created_at=STAMP)
    place = next(p for p in sorted(Path(folder).glob("part-*")) if '"n1"' in p.read_text())
    place.with_name(f".{place.name}.crc").unlink()
    place.write_text(f"{line}\n{place.read_text()}")
    with pytest.raises(graph_json.GraphError):
        graph_json.read_lines(spark, folder)


def test_places_by_range_partitions(spark):
    rows = [(f"{i * 7919 % 1009}",) for i in range(1009)]
    got = numbered(spark.createDataFrame(rows, "id string").repartition(5), "id", "n").collect()
    assert {r.id: r.n for r in got} == {k: i + 1 for i, k in enumerate(sorted(r[0] for r in rows))}


def test_no_row_holds_the_whole_graph(spark, tmp_path):
    spark.range(3000).selectExpr("id AS p_partkey", "concat('name ', id) AS p_name", "'Brand#1' AS p_brand", "'T' AS p_type", "cast(id % 50 + 1 AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    before = {p.name for p in Path(graph_json_scratch(spark)).glob("graph-*")}
    assert sources.graph_file_scan(spark, str(tmp_path)).count() == 3000
    made = [p for p in Path(graph_json_scratch(spark)).glob("graph-*") if p.name not in before]
    longest = [max(map(len, f.read_text().splitlines() or [""])) for folder in made for f in folder.glob("graph.json/part-*")]
    assert longest and max(longest) < 1000


def graph_json_scratch(spark):
    from cairnlake import session

    return str(Path(session.scratch_folder(spark, "probe")).parent)
