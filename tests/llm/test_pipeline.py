from pathlib import Path

import pytest
from pyspark.sql import functions

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the tables aren't there")


def test_stages_hand_on_documents(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, before = [n for n, _ in p.STAGES], docs.columns
    assert names == ["toxicity", "jaccard_join", "decontamination", "secret_scans", "mixing"]
    counts = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = p.persist(stage(spark, docs, DATA))
        assert docs.columns == before, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4] > counts[0] / 2
    assert p.STAGES[-1][1](spark, docs, DATA).columns == [*before, "copy"]
    once, again = (sorted((r.doc_id, r.copy) for r in p.run(spark, DATA).select("doc_id", "copy").collect()) for _ in range(2))
    assert once == again and once


def test_stages_on_edge_cases(spark, docs):
    """Null and empty texts, repeated rows and ids, null ids and columns named like the stages' own; then no row at all."""
    import corpus_pipeline as p

    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words), (1, words), (2, words + " x"), (2, "an own text of document two"), (3, None), (3, None), (4, ""), (None, None), (None, "a text without an id"), (5, "token=Zk3vQ9xW7pL2mT8rB5nJ and more"), (6, "word " * 20_000)]
    for df in (docs(rows, extra=True).withColumn("copy", functions.lit("c")), docs([])):
        columns = df.columns
        for name, stage in p.STAGES[:-1]:
            df = p.persist(stage(spark, df, DATA))
            assert df.columns == columns, name
        ids = sorted(str(r.doc_id) for r in df.collect())
        assert ids in ([], ["1", "2", "3", "3", "4", "5", "6", "None", "None"])
        mixed = p.STAGES[-1][1](spark, df, DATA)
        assert mixed.columns == [*columns, "copy_" if "copy" in columns else "copy"] and mixed.count() >= 0


def test_no_text_reaches_the_driver_in_training(spark, docs):
    """The fit's sample stays on the executors: only weights and counts are collected."""
    from cairnlake.llm import toxicity

    seen = []
    real = type(spark.range(1)).collect
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(spark.range(1)), "collect", lambda self: seen.append(self.columns) or real(self))
        labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
        assert toxicity.train(docs([(i, "gronkish words" if i % 2 else "plain words") for i in range(60)]), labels)[0] is not None
    assert seen and all("text" not in columns for columns in seen)


def test_llm_queries_equal_sql(spark):
    import duckdb

    from cairnlake.llm import queries

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name, sql in queries.ORACLE_SQL.items():
        df, found = queries.QUERIES[name](spark, DATA), con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        assert sorted(repr([r[c] for c in order]) for r in df.collect()) == sorted(repr([dict(zip(names, r))[c] for c in order]) for r in found.fetchall()), name
