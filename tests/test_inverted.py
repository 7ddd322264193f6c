"""The stored inverted index against plain ranking, and what it reads."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import inverted, retrieval

TEXT = "text"


def corpus(dice, n):
    words = [f"w{i}" for i in range(200)]
    rows = [(i * 3, " ".join(dice.choices(words, weights=[1 / (k + 1) for k in range(200)], k=dice.randint(1, 60)))) for i in range(n)]
    return rows + [(10**12, None), (10**12 + 1, ""), (-5, "w0 w0 rare"), (10**15, "rare w199 w0")]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = corpus(random.Random(1), 1500)
    docs, folder = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), f"file://{tmp_path_factory.mktemp('postings')}/index"
    inverted.build(docs, folder, id_col="doc_id", text=TEXT, buckets=8, block=16)
    return docs, rows, inverted.Index(spark, folder)


@pytest.mark.parametrize("query,heads,spans", [("rare", 256, 4096), ("w0 w1 rare w0", 2, 7), ("w199 w198 w197 w0 nowhere", 2, 7)])
def test_ranking_equals_a_full_scan(made, monkeypatch, query, heads, spans):
    monkeypatch.setattr(inverted, "HEADS", heads)
    monkeypatch.setattr(inverted, "SPANS", spans)
    docs, _, index = made
    plain = {r.doc_id: r.bm25 for r in retrieval.bm25_scores(docs, query, keep=["doc_id"]).where("bm25 > 0").collect()}
    for k, slack in ((5, 0.0), (12, 0.01)):
        found = {r.doc: r.bm25 for r in index.top_k(query, k, slack=slack).collect()}
        last = sorted(plain.values(), reverse=True)[: k][-1] - slack
        assert found == pytest.approx({d: s for d, s in plain.items() if s >= last - 1e-12})


def test_nothing_asked_and_nothing_there(spark, made, tmp_path):
    assert made[2].top_k("", 5).collect() == [] == made[2].top_k("nowhere", 5).collect()
    inverted.build(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/e", id_col="doc_id", text=TEXT)
    assert inverted.Index(spark, f"{tmp_path}/e").top_k("w0", 5).collect() == []


def test_postings_are_whole_and_blocks_bounded(made):
    _, rows, index = made
    tokens = {d: re.findall("[a-z0-9_$]{2,}", t or "") for d, t in rows}
    assert (index.docs, index.tokens) == (len(rows), sum(map(len, tokens.values())))
    assert index.frequencies(["w0", "rare", "zz"]) == {"w0": sum("w0" in t for t in tokens.values()), "rare": 2}
    blocks = index.blocks(["w0", "rare"]).collect()
    assert max(b.n for b in blocks) == 16 and all(b.first_doc <= b.last_doc for b in blocks)
    assert max(b.max_tf for b in blocks) == max(t.count("w0") for t in tokens.values())


def test_only_the_asked_buckets_are_read(made):
    plan = made[2].blocks(["w0"])._jdf.queryExecution().toString()
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)
    assert "bucket" in filters[1] and "token" in filters[2]
    files = {f.split("bucket=")[1].split("/")[0] for f in made[2].blocks(["w0"]).inputFiles()}
    assert len(files) <= 8
    read = made[2].blocks(["w0"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r.f.split("bucket=")[1].split("/")[0] for r in read}) == 1


def test_blocks_that_cannot_reach_the_best_are_left_shut(spark, tmp_path):
    """Long documents everywhere, short ones of the token at one place: most blocks stay shut."""
    rows = [(i, "hit " + "pad " * (2 if 500 <= i < 540 else 60 + i % 7)) for i in range(4000)]
    inverted.build(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/i", id_col="doc_id", text=TEXT, buckets=4, block=16)
    index = inverted.Index(spark, f"{tmp_path}/i")
    df = index.frequencies(["hit"])
    blocks = index.blocks(["hit"]).withColumn("bound", index._part(df, F.col("max_tf"), F.col("min_length")))
    least = sorted(r.bm25 for r in index.top_k("hit", 20).collect())[0]
    left = index.open_blocks(blocks, df, least).count()
    assert blocks.count() == math.ceil(4000 / 16) and 3 <= left <= 6
    assert {r.doc for r in index.top_k("hit", 20).collect()} == set(range(500, 540))  # ties are kept
