"""Queries of ranked retrieval over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions import scoring, text
from cairnlake.operators import code, deps, inverted, retrieval, vectors
from cairnlake.queries.model import CHUNKS_SQL, DOCUMENTS_SQL, TOKENS_SQL, chunks, documents, related_labels, rounded_sql, table
from cairnlake.session import scratch_folder

QUERY = "the and thion"
FIELD_QUERY = "src1 the en quality"
LIMIT = 20
_T = TOKENS_SQL.format("text")


def _bm25_sql(tokens: list[str], source: str, alias: str = "bm25") -> str:
    """CTEs tok, stats and the score column over a relation with columns t (tokens) and any others."""
    tf = ", ".join(f"len([x for x in t if x = '{w}']) AS tf_{i}" for i, w in enumerate(tokens))
    df = ", ".join(f"sum(CASE WHEN tf_{i} > 0 THEN 1 ELSE 0 END) AS df_{i}" for i in range(len(tokens)))
    part = lambda i: f"CASE WHEN tf_{i} > 0 THEN ln(1.0::DOUBLE + (docs::DOUBLE - df_{i}::DOUBLE + 0.5::DOUBLE) / (df_{i}::DOUBLE + 0.5::DOUBLE)) * (tf_{i}::DOUBLE * 2.2::DOUBLE / (tf_{i}::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (n_tokens::DOUBLE / greatest(1.0::DOUBLE, avg_tokens))))) ELSE 0.0::DOUBLE END"
    return f"tok AS (SELECT *, len(t) AS n_tokens, {tf} FROM {source}), stats AS (SELECT count(*) AS docs, avg(n_tokens) AS avg_tokens, {df} FROM tok), scored AS (SELECT tok.*, 0.0::DOUBLE + {' + '.join(part(i) for i in range(len(tokens)))} AS {alias} FROM tok, stats)"


def tokenize_counts(spark, sf_dir):
    t = text.tokens("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


TOKENIZE_SQL = f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, {_T} AS t FROM documents)"


def bm25_df(spark, sf_dir):
    return retrieval.document_frequencies(table(spark, sf_dir, "documents"), F.col("text"))


BM25_DF_SQL = f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({_T})) AS token FROM documents) GROUP BY token"


def bm25_corpus_stats(spark, sf_dir):
    terms = retrieval.term_columns(table(spark, sf_dir, "documents"), text.query_tokens(QUERY), F.col("text"))
    s = retrieval.corpus_stats(terms, 3)
    return s.select("docs", text.rounded("avg_tokens").alias("avg_tokens"), *[f"df_{i}" for i in range(3)])


_W = ["the", "and", "thion"]
BM25_STATS_SQL = f"WITH base AS (SELECT doc_id, {_T} AS t FROM documents), {_bm25_sql(_W, 'base')} SELECT docs, {rounded_sql('avg_tokens')} AS avg_tokens, CAST(df_0 AS BIGINT) AS df_0, CAST(df_1 AS BIGINT) AS df_1, CAST(df_2 AS BIGINT) AS df_2 FROM stats"


def bm25_topk(spark, sf_dir):
    scored = retrieval.bm25_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY, keep=["doc_id"])
    best = scored.where("bm25 > 0").select("doc_id", text.rounded("bm25").alias("score"))
    return best.orderBy(F.desc("score"), "doc_id").limit(LIMIT)


BM25_TOPK_SQL = f"WITH base AS (SELECT doc_id, {_T} AS t FROM documents), {_bm25_sql(_W, 'base')} SELECT doc_id, {rounded_sql('bm25')} AS score FROM scored WHERE bm25 > 0 ORDER BY score DESC, doc_id LIMIT {LIMIT}"


def bm25_indexed_topk(spark, sf_dir):
    """The same ranking from a stored index, which is built first."""
    folder = scratch_folder(spark, "postings")
    inverted.build(table(spark, sf_dir, "documents"), folder, id_col="doc_id", text=F.col("text"))
    best = inverted.Index(spark, folder).top_k(QUERY, LIMIT, slack=1e-4)  # of equal rounded scores the lesser ids are shown
    return best.where("bm25 > 0").select(F.col("doc").alias("doc_id"), text.rounded("bm25").alias("score")).orderBy(F.desc("score"), "doc_id").limit(LIMIT)


BATCH = [(1, "the and thion"), (2, "elle avec dans"), (3, "der und thion"), (4, "nothing matches zzzz")]


def bm25_batch(spark, sf_dir):
    asked = spark.createDataFrame(BATCH, "qid int, query string")
    found = retrieval.batch_bm25(table(spark, sf_dir, "documents"), asked, id_col="doc_id", text=F.col("text"), limit=10)
    return found.select("qid", F.col("id").alias("doc_id"), text.rounded("bm25", 3).alias("score"))


def _batch_sql() -> str:
    asked = ", ".join(f"({q}, '{w}')" for q, s in BATCH for w in dict.fromkeys(text.query_tokens(s)))
    return f"""
WITH asked(qid, token) AS (VALUES {asked}), base AS (SELECT doc_id, {_T} AS t FROM documents),
sizes AS (SELECT count(*) AS docs, avg(len(t)) AS avg_tokens FROM base),
postings AS (SELECT doc_id, token, n_tokens, count(*) AS tf FROM (SELECT doc_id, len(t) AS n_tokens, unnest(t) AS token FROM base) WHERE token IN (SELECT token FROM asked) GROUP BY ALL),
dfs AS (SELECT token, count(*) AS df FROM postings GROUP BY token),
parts AS (SELECT qid, doc_id, ln(1 + (docs::DOUBLE - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (n_tokens / greatest(1.0::DOUBLE, avg_tokens))))) AS p FROM postings JOIN dfs USING (token) JOIN asked USING (token), sizes),
summed AS (SELECT qid, doc_id, sum(p) AS s FROM parts GROUP BY ALL)
SELECT CAST(qid AS INTEGER) AS qid, doc_id, {rounded_sql("s", 3)} AS score FROM summed QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) <= 10"""


# --- field scores ---------------------------------------------------------------------


def _ranked(spark, sf_dir):
    return retrieval.rank_chunks(chunks(spark, sf_dir), FIELD_QUERY, related_labels(spark, sf_dir), keep=["doc_id"])


_FT = text.query_tokens(FIELD_QUERY)
_DOC = TOKENS_SQL.format("concat_ws(chr(10), file_path, chunk_type, 'const ' || symbol, module, export, content)")


def _hit(column: str, needle: str, points: float) -> str:
    return f"CASE WHEN contains(lower({column}), '{needle}') THEN {points}::DOUBLE ELSE 0.0::DOUBLE END"


def _field_sql() -> str:
    low = FIELD_QUERY.lower()
    total = lambda column, exact, points: " + ".join(["0.0::DOUBLE", *([_hit(column, low, exact)] if exact else []), *[_hit(column, t, points) for t in _FT]])
    points = scoring.TOKEN_POINTS
    parts = {"content": f"0.0::DOUBLE + {_hit('content', low, 2.0)}", "export": total("export", 0, points["export"]), "import": total("module", 0, points["import"]), "path": total("file_path", 4.0, points["path"]), "related_graph_node": total("coalesce(related, '')", 0, points["related_graph_node"]), "symbol": total("symbol", 5.0, points["symbol"])}
    columns = ", ".join(f"{v} AS f_{k}" for k, v in parts.items())
    return f"""{CHUNKS_SQL}, base AS (SELECT *, {_DOC} AS t FROM chunks), {_bm25_sql(_FT, "base")},
fields AS (SELECT *, {columns} FROM scored), ranked AS (SELECT *, 0.0::DOUBLE + bm25 + {" + ".join(f"f_{k}" for k in parts)} AS score FROM fields)"""


def field_score_topk(spark, sf_dir):
    best = _ranked(spark, sf_dir).withColumn("s", text.rounded("score")).orderBy(F.desc("s"), "doc_id").limit(LIMIT)
    return best.select("doc_id", F.col("s").alias("score"), text.rounded("score_breakdown.bm25").alias("bm25"), *[F.col(f"score_breakdown.{c}").alias(f"s_{c}") for c in ("content", "export", "import", "path", "related_graph_node", "symbol")])


FIELD_SQL = f"WITH {_field_sql()} SELECT doc_id, {rounded_sql('score')} AS score, {rounded_sql('bm25')} AS bm25, f_content AS s_content, f_export AS s_export, f_import AS s_import, f_path AS s_path, f_related_graph_node AS s_related_graph_node, f_symbol AS s_symbol FROM ranked WHERE score > 0 ORDER BY 2 DESC, doc_id LIMIT {LIMIT}"


def match_reasons_top8(spark, sf_dir):
    said = F.array_join(F.transform("match_reasons", lambda r: F.concat_ws("=", r["field"], F.format_string("%.2f", r["score"]))), ";")
    fixed = F.array_join(F.transform(F.filter("match_reasons", lambda r: r["field"] != "bm25"), lambda r: F.concat_ws("=", r["field"], F.format_string("%.2f", r["score"]))), ";")
    rows = retrieval.with_reasons(_ranked(spark, sf_dir), chunks(spark, sf_dir), FIELD_QUERY, key="doc_id")
    return rows.select("doc_id", fixed.alias("reasons"), F.size("match_reasons").alias("n_reasons"), (F.length(said) > 0).alias("has_reasons"))


REASONS_SQL = f"""
WITH {_field_sql()}, said AS (
  SELECT doc_id, f_export AS score, 'export' AS field FROM ranked WHERE score > 0 AND f_export > 0 UNION ALL
  SELECT doc_id, f_import, 'import' FROM ranked WHERE score > 0 AND f_import > 0 UNION ALL
  SELECT doc_id, f_path, 'path' FROM ranked WHERE score > 0 AND f_path > 0 UNION ALL
  SELECT doc_id, f_related_graph_node, 'related_graph_node' FROM ranked WHERE score > 0 AND f_related_graph_node > 0 UNION ALL
  SELECT doc_id, f_symbol, 'symbol' FROM ranked WHERE score > 0 AND f_symbol > 0 UNION ALL
  SELECT doc_id, f_content, 'content' FROM ranked WHERE score > 0 AND f_content > 0
), joined AS (SELECT doc_id, string_agg(field || '=' || printf('%.2f', score), ';' ORDER BY score DESC, field) AS reasons, count(*) AS n FROM said GROUP BY doc_id)
SELECT doc_id, coalesce(reasons, '') AS reasons,
       CAST(coalesce(n, 0) + CASE WHEN bm25 > 0 AND ({" OR ".join(f"contains(lower(content), '{t}')" for t in _FT)}) THEN 1 ELSE 0 END AS INTEGER) AS n_reasons,
       coalesce(n, 0) + CASE WHEN bm25 > 0 AND ({" OR ".join(f"contains(lower(content), '{t}')" for t in _FT)}) THEN 1 ELSE 0 END > 0 AS has_reasons
FROM ranked LEFT JOIN joined USING (doc_id) WHERE score > 0"""


def diversified_search(spark, sf_dir):
    scored = retrieval.bm25_scores(documents(spark, sf_dir).select("doc_id", "source", "text"), QUERY, keep=["doc_id", "source"]).where("bm25 > 0").withColumn("score", text.rounded("bm25"))
    return retrieval.diversified(scored, 40, file_col="source", order=[F.desc("score"), F.col("doc_id")]).select("doc_id", "source", "score", "tier")


DIVERSIFIED_SQL = f"""
WITH base AS (SELECT doc_id, source, {_T} AS t FROM documents), {_bm25_sql(_W, "base")}, r AS (SELECT doc_id, source, {rounded_sql("bm25")} AS score FROM scored WHERE bm25 > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS k FROM r)
SELECT doc_id, source, score, CAST(CASE WHEN k = 1 THEN 1 WHEN k <= 10 THEN 2 ELSE 3 END AS INTEGER) AS tier FROM f ORDER BY 4, score DESC, doc_id LIMIT 40"""


def total_matches(spark, sf_dir):
    return _ranked(spark, sf_dir).agg(F.count(F.lit(1)).alias("total_results"))


TOTAL_SQL = f"WITH {_field_sql()} SELECT count(*) AS total_results FROM ranked WHERE score > 0"


def snippet_window(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet("text", "thion").alias("snippet"))


SNIPPET_SQL = "SELECT doc_id, CASE WHEN p > 0 THEN substr(text, greatest(p - 24, 1), p + 5 + 56 - greatest(p - 24, 1)) ELSE substr(text, 1, 80) END AS snippet FROM (SELECT doc_id, text, instr(lower(text), 'thion') AS p FROM documents)"


def truncate_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview("text", 300).alias("preview"))


PREVIEW_SQL = "SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 300) || chr(10) || '// ... truncated' END AS preview FROM documents"


def range_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.range_hash("text", F.lit(2), F.lit(4)).alias("range_hash"), text.sha256("text").alias("content_hash"))


RANGE_HASH_SQL = "SELECT doc_id, 'sha256:' || sha256(coalesce(array_to_string(l[2:4], chr(10)), '')) AS range_hash, 'sha256:' || sha256(text) AS content_hash FROM (SELECT doc_id, text, string_split_regex(text, '\\r?\\n') AS l FROM documents)"


def line_measures(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.n_lines("text").alias("n_lines"), text.n_lines_trimmed("text").alias("n_lines_trimmed"), F.length(text.collapse("text")).alias("collapsed_length"))


LINES_SQL = "SELECT doc_id, CAST(len(l) AS INTEGER) AS n_lines, CAST(greatest(len(l) - CASE WHEN l[len(l)] = '' THEN 1 ELSE 0 END, 1) AS INTEGER) AS n_lines_trimmed, CAST(length(regexp_replace(regexp_replace(text, '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g'), '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS INTEGER) AS collapsed_length FROM (SELECT doc_id, text, string_split_regex(text, '\\r?\\n') AS l FROM documents)"


def chunk_lines(spark, sf_dir):
    """Chunks of documents: a line that begins with a capital T and ends a word opens one, the lines before are the preamble."""
    rows = documents(spark, sf_dir).withColumn("l", text.lines("text"))
    heads = F.filter(F.transform("l", lambda x, i: F.struct(F.regexp_extract(x, "^(T[a-z]*)", 1).alias("name"), F.lit("const").alias("kind"), (i + 1).alias("line"), F.lit(False).alias("exported"))), lambda s: s["name"] != "")
    rows = rows.select("doc_id", "file_path", F.lit("text").alias("language"), "l", F.col("text").alias("content"), heads.alias("symbols"), F.size("l").alias("line_count"), F.array().cast("array<struct<module:string,line:int>>").alias("imports"), F.array().cast("array<string>").alias("exports"), text.sha256("text").alias("content_hash"))
    made = code.chunks(rows.drop("l", "doc_id"))
    return made.select("id", "start_line", "end_line", "chunk_type", F.sha2("content", 256).alias("content_sha"))


CHUNK_LINES_SQL = f"""
WITH {DOCUMENTS_SQL}, l AS (SELECT doc_id, file_path, string_split_regex(text, '\\r?\\n') AS l FROM docs),
lined AS (SELECT doc_id, file_path, len(l) AS n, l, unnest(range(1, len(l) + 1)) AS i FROM l),
heads AS (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM lined WHERE regexp_matches(l[i], '^T[a-z]*')),
spans AS (
  SELECT file_path, l, i AS s, CASE WHEN nxt IS NULL THEN n ELSE greatest(i, nxt - 1) END AS e, 'const' AS kind FROM heads
  UNION ALL SELECT file_path, l, 1, i - 1, 'mixed' FROM (SELECT file_path, l, min(i) AS i FROM heads GROUP BY ALL) WHERE i > 1 AND regexp_matches(array_to_string(l[1 : i - 1], ''), '[^ \\t\\n\\v\\f\\r]')
  UNION ALL SELECT file_path, l, 1, len(l), 'file' FROM l WHERE doc_id NOT IN (SELECT doc_id FROM heads)
)
SELECT file_path || ':' || s || '-' || e AS id, CAST(s AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line, kind AS chunk_type, sha256(regexp_replace(array_to_string(l[s : e], chr(10)), '[ \\t\\n\\v\\f\\r]+$', '')) AS content_sha FROM spans"""


def area_rollup(spark, sf_dir):
    return code.areas(documents(spark, sf_dir), F.col("file_path"), F.col("n_chars"))


AREA_SQL = f"WITH {DOCUMENTS_SQL} SELECT split_part(file_path, '/', 1) AS name, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS symbols FROM docs GROUP BY 1 ORDER BY files DESC, name LIMIT 10"


def export_highlights(spark, sf_dir):
    return code.export_highlights(chunks(spark, sf_dir).select("file_path", "symbols"))


EXPORT_SQL = f"WITH {CHUNKS_SQL} SELECT file_path, symbol AS name, 'const' AS kind, CAST(1 AS INTEGER) AS line FROM chunks ORDER BY file_path LIMIT 24"


def approx_references(spark, sf_dir):
    names = spark.createDataFrame([("Thion",), ("elle",), ("Und",)], "name string")
    return deps.symbol_mentions(names, table(spark, sf_dir, "documents"), id_col="doc_id", text=F.col("text")).select("name", F.col("id").alias("doc_id"))


REFERENCES_SQL = "SELECT name, doc_id FROM (VALUES ('Thion'), ('elle'), ('Und')) v(name), documents WHERE contains(lower(text), lower(name))"

def first_word_mentions(spark, sf_dir):
    """Texts that mention the first word of another text, five characters or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select(F.regexp_extract("text", "^[A-Za-z]{5,}", 0).alias("name")).where("name <> ''").distinct()
    return deps.symbol_mentions(words, docs, id_col="doc_id", text=F.col("text")).select("name", F.col("id").alias("doc_id"))


FIRST_WORD_SQL = "WITH v AS (SELECT DISTINCT regexp_extract(text, '^[A-Za-z]{5,}') AS name FROM documents) SELECT name, doc_id FROM v, documents WHERE name <> '' AND contains(lower(text), lower(name))"

def nearest_vectors(spark, sf_dir):
    """The ten nearest of all vectors for every vector whose id is divisible by 20, exactly."""
    rows = table(spark, sf_dir, "embeddings")
    cells = vectors.Cells(rows, id_col="vec_id", vector_col="embedding")
    found = cells.nearest(rows.where("vec_id % 20 = 0"), 10, id_col="vec_id", vector_col="embedding", exact=True)
    return found.select("query", "id", text.rounded("similarity").alias("similarity"), "rank")


NEAREST_SQL = f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(q.v, e.v), 9) AS s FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT query, id, {rounded_sql("s")} AS similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS INTEGER) AS rank FROM p QUALIFY rank <= 10"""

REGISTRY = {
    "tokenize_counts": (tokenize_counts, TOKENIZE_SQL),
    "bm25_df": (bm25_df, BM25_DF_SQL),
    "bm25_corpus_stats": (bm25_corpus_stats, BM25_STATS_SQL),
    "bm25_topk": (bm25_topk, BM25_TOPK_SQL),
    "bm25_indexed_topk": (bm25_indexed_topk, BM25_TOPK_SQL),
    "first_word_mentions": (first_word_mentions, FIRST_WORD_SQL),
    "nearest_vectors": (nearest_vectors, NEAREST_SQL),
    "bm25_batch": (bm25_batch, _batch_sql()),
    "field_score_topk": (field_score_topk, FIELD_SQL),
    "match_reasons_top8": (match_reasons_top8, REASONS_SQL),
    "diversified_search": (diversified_search, DIVERSIFIED_SQL),
    "total_matches": (total_matches, TOTAL_SQL),
    "snippet_window": (snippet_window, SNIPPET_SQL),
    "truncate_preview": (truncate_preview, PREVIEW_SQL),
    "range_hash": (range_hash, RANGE_HASH_SQL),
    "line_measures": (line_measures, LINES_SQL),
    "chunk_lines": (chunk_lines, CHUNK_LINES_SQL),
    "area_rollup": (area_rollup, AREA_SQL),
    "export_highlights": (export_highlights, EXPORT_SQL),
    "approx_references": (approx_references, REFERENCES_SQL),
}
