"""Ranked retrieval: corpus statistics, BM25, field scores, per-file diversification.

A query is a few constant tokens, so term frequencies are plain columns. Each
text is read and tokenised once, into a narrow table of keys, lengths, term
frequencies and field points; the corpus statistics are one aggregation of that
table, whose single row is joined back to it. No posting list is built, texts are
never shuffled, and those of the best rows are fetched by key at the end.
``batch_bm25`` ranks many queries in one job.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairnlake.functions import scoring
from cairnlake.functions.text import chunk_document, query_tokens, tokens, with_values
from cairnlake.session import written

RELATED = "array<struct<id:string,kind:string,name:string,summary:string>>"
#: Up to so many asked tokens are filtered in each text's array, more by a join of postings.
FEW_TOKENS = 256


def term_columns(docs: DataFrame, query: list[str], text: Column) -> DataFrame:
    """``docs`` with n_tokens and tf_0 .. of the distinct query tokens."""
    rows = docs.withColumn("__tokens", tokens(text))
    counts = {f"tf_{i}": F.size(F.filter("__tokens", _equals(t))) for i, t in enumerate(dict.fromkeys(query))}
    return rows.withColumns({"n_tokens": F.size("__tokens")} | counts).drop("__tokens")


def _equals(token: str):
    return lambda t: t == token


def corpus_stats(terms: DataFrame, n_terms: int) -> DataFrame:
    """One row: docs, avg_tokens (0 for no documents), df_0 .."""
    return terms.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.avg("n_tokens"), F.lit(0.0)).alias("avg_tokens"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(n_terms)])


def bm25_column(n_terms: int) -> Column:
    total = F.lit(0.0)
    for i in range(n_terms):
        total = total + scoring.bm25_term(F.col(f"tf_{i}"), F.col(f"df_{i}"), F.col("docs"), F.col("n_tokens"), F.col("avg_tokens"))
    return total


def with_bm25(terms: DataFrame, n_terms: int) -> DataFrame:
    """``terms`` (a narrow table with n_tokens, tf_0 ..) with unrounded ``bm25`` in place of these; the row of statistics is broadcast."""
    scored = terms.join(F.broadcast(corpus_stats(terms, n_terms)), how="cross")
    helpers = ["docs", "avg_tokens", "n_tokens", *[f"{p}_{i}" for p in ("tf", "df") for i in range(n_terms)]]
    return scored.withColumn("bm25", bm25_column(n_terms)).drop(*helpers)


def bm25_scores(docs: DataFrame, query: str, text: Column | None = None, *, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if none are named) and their ``bm25``; one pass over the texts."""
    distinct = list(dict.fromkeys(query_tokens(query)))
    terms = term_columns(docs, distinct, F.col("text") if text is None else text)
    kept = docs.columns if keep is None else keep
    return with_bm25(written(terms.select(*kept, "n_tokens", *[f"tf_{i}" for i in range(len(distinct))])), len(distinct))


def document_frequencies(docs: DataFrame, text: Column) -> DataFrame:
    """(token, df) over all tokens of the corpus."""
    return docs.select(F.explode(F.array_distinct(tokens(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def batch_bm25(docs: DataFrame, queries: DataFrame, *, id_col: str, text: Column, limit: int) -> DataFrame:
    """The best ``limit`` documents of every query (qid, query) in one job, over the asked tokens only; one pass over the texts."""
    asked = queries.select("qid", F.explode(F.array_distinct(tokens("query"))).alias("token"))
    wanted = asked.select("token").distinct()
    rows = docs.select(F.col(id_col).alias("id"), tokens(text).alias("t"))
    if wanted.count() <= FEW_TOKENS:
        one = F.broadcast(wanted.agg(F.collect_list("token").alias("wanted")))
        own = with_values(lambda t, w: F.filter(t, lambda x: F.array_contains(w, x)), F.col("t"), F.col("wanted"))
        narrow = written(rows.join(one, how="cross").select("id", F.size("t").alias("n_tokens"), own.alias("t")))
        found = narrow.select("id", "n_tokens", F.explode("t").alias("token"))
    else:
        narrow = written(rows.select("id", F.size("t").alias("n_tokens"), "t"))
        found = narrow.select("id", "n_tokens", F.explode("t").alias("token")).join(wanted, "token", "left_semi")
    sizes = narrow.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.avg("n_tokens"), F.lit(0.0)).alias("avg_tokens"))
    postings = found.groupBy("token", "id", "n_tokens").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    part = scoring.bm25_term(F.col("tf"), F.col("df"), F.col("docs"), F.col("n_tokens"), F.col("avg_tokens"))
    scored = postings.join(df, "token").join(F.broadcast(sizes), how="cross").select("token", "id", part.alias("part")).join(asked, "token").groupBy("qid", "id").agg(F.sum("part").alias("bm25"))
    best = W.partitionBy("qid").orderBy(F.desc("bm25"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def related_nodes(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(file_path, related): summaries of the nodes anchored to each file, once each, in document order; deprecated ones too."""
    pairs = anchors.select("file_path", F.col("node_id").alias("id")).distinct().join(nodes.select("id", "kind", "name", "summary", "map_pos"), "id")
    grouped = pairs.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("map_pos", "id", "kind", "name", "summary"))).alias("r"))
    return grouped.select("file_path", F.transform("r", lambda x: F.struct(x["id"].alias("id"), x["kind"].alias("kind"), x["name"].alias("name"), x["summary"].alias("summary"))).alias("related"))


def rank_chunks(chunks: DataFrame, query: str, related: DataFrame | None = None, *, keep: list[str]) -> DataFrame:
    """``keep`` and file_path of the chunks with a positive score, with bm25, score_breakdown, score and related: narrow rows.

    Points of the chunk's own fields come from the one pass over the texts, those
    of related nodes from a join of ``related`` (file_path, related) with the narrow rows.
    """
    distinct = list(dict.fromkeys(query_tokens(query)))
    own = [f for f in scoring.FIELDS if f != "related_graph_node"]
    points = [p.alias(f"p_{f}") for f, p in scoring.field_points(query, tuple(own)).items()]
    kept = [*dict.fromkeys([*keep, "file_path"])]
    terms = term_columns(chunks, distinct, chunk_document())
    narrow = written(terms.select(*kept, *points, "n_tokens", *[f"tf_{i}" for i in range(len(distinct))]))
    scored = with_bm25(narrow, len(distinct))
    empty = F.array().cast(RELATED)
    scored = scored.join(related, "file_path", "left").withColumn("related", F.coalesce("related", empty)) if related is not None else scored.withColumn("related", empty)
    around = scoring.field_points(query, ("related_graph_node",))["related_graph_node"]
    part = lambda f: around.alias(f) if f == "related_graph_node" else F.col(f"p_{f}").alias(f)
    scored = scored.withColumn("score_breakdown", F.struct(F.col("bm25"), *[part(f) for f in scoring.FIELDS]))
    return scored.drop(*[f"p_{f}" for f in own]).withColumn("score", scoring.chunk_score(F.col("score_breakdown"))).where("score > 0")


def with_reasons(best: DataFrame, chunks: DataFrame, query: str, *, key: str) -> DataFrame:
    """Rows of ``rank_chunks`` with the other columns of their chunks and ``match_reasons``; meant for the rows that are shown."""
    more = chunks.select(F.col(key).alias("__key"), *[c for c in chunks.columns if c not in best.columns])
    met = best.join(more, F.col(key) == F.col("__key")).drop("__key")
    return met.withColumn("match_reasons", scoring.chunk_reasons(query, F.col("bm25")))


def diversified(ranked: DataFrame, limit: int, *, file_col: str, order: list[Column]) -> DataFrame:
    """The first ``limit`` rows, one a file first, then up to max(2, limit / 4) a file, then the rest, each by ``order``.

    A file's rows beyond the limit can't be among the first, so they are cut
    before the rows of all files meet.
    """
    most = max(2, math.ceil(limit / 4))
    in_file = ranked.withColumn("file_rank", F.row_number().over(W.partitionBy(file_col).orderBy(*order))).where(F.col("file_rank") <= limit)
    tier = F.when(F.col("file_rank") == 1, 1).when(F.col("file_rank") <= most, 2).otherwise(3)
    return in_file.withColumn("tier", tier).orderBy("tier", *order).limit(limit)
