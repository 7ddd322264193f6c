"""Relevance: lexical scores of graph nodes, BM25, and field scores of source chunks, with their reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnlake.functions.text import query_tokens, snippet, with_values

K1, B = 1.2, 0.75
MAX_REASONS = 8
#: Fields of a chunk's score beside BM25, in the order in which they are added up.
FIELDS = ("content", "export", "import", "path", "related_graph_node", "symbol")
# Points for a hit in each field.
NODE_POINTS = {"tag": 2.0, "name": 1.0, "summary": 1.0, "alias": 1.5}
EXACT_POINTS = {"path": 4.0, "symbol": 5.0, "content": 2.0}
TOKEN_POINTS = {"path": 1.5, "symbol": 3.0, "import": 1.0, "export": 1.0, "related_graph_node": 1.25}


def first_with(values: Column, token: str, text=lambda v: v) -> Column:
    """The first element whose text contains ``token``; null if none does."""
    return F.get(F.filter(values, lambda v: F.lower(text(v)).contains(token)), F.lit(0))


def _points(hit: Column, points: float) -> Column:
    return F.when(hit, points).otherwise(0.0)


def _sum(terms: list[Column]) -> Column:
    total = F.lit(0.0)
    for term in terms:
        total = total + term
    return total


# --- graph nodes -----------------------------------------------------------------


def node_breakdown(tokens: list[str], *, name="name", summary="summary", tags="tags", aliases="aliases") -> Column:
    """struct(alias, name, summary, tag) of points; a repeated token counts again."""
    fields = {
        "alias": lambda t: F.coalesce(F.exists(aliases, lambda a: F.lower(a).contains(t)), F.lit(False)),
        "name": lambda t: F.lower(name).contains(t),
        "summary": lambda t: F.lower(summary).contains(t),
        "tag": lambda t: F.coalesce(F.exists(tags, lambda a: F.lower(a).contains(t)), F.lit(False)),
    }
    return F.struct(*[_sum([_points(hit(t), NODE_POINTS[f]) for t in tokens]).alias(f) for f, hit in fields.items()])


def node_score(breakdown: Column) -> Column:
    return breakdown["alias"] + breakdown["name"] + breakdown["summary"] + breakdown["tag"]


def node_reasons(tokens: list[str], *, name="name", summary="summary", tags="tags", aliases="aliases") -> Column:
    """Up to eight struct(field, token, value, score), best first."""
    made = []
    for t in tokens:
        for field, value in (("tag", first_with(F.col(tags), t)), ("name", F.when(F.lower(name).contains(t), F.col(name))), ("summary", F.when(F.lower(summary).contains(t), snippet(summary, t))), ("alias", first_with(F.col(aliases), t))):
            made.append(F.when(value.isNotNull(), F.struct(F.lit(-NODE_POINTS[field]).alias("s"), F.lit(field).alias("field"), F.lit(t).alias("token"), value.alias("value"))))
    return _top(made, "field", "token", "value")


def _top(reasons: list[Column], *fields: str) -> Column:
    """The best eight of structs led by a negated score ``s``."""
    if not reasons:
        return F.array().cast("array<struct<" + ",".join(f"{f}:string" for f in fields) + ",score:double>>")
    best = F.slice(F.array_sort(F.filter(F.array(*reasons), lambda r: r.isNotNull())), 1, MAX_REASONS)
    return F.transform(best, lambda r: F.struct(*[r[f].alias(f) for f in fields], (-r["s"]).alias("score")))


# --- BM25 ---------------------------------------------------------------------------


def idf(docs: Column, df: Column) -> Column:
    return F.ln(F.lit(1.0) + (docs.cast("double") - df.cast("double") + F.lit(0.5)) / (df.cast("double") + F.lit(0.5)))


def bm25_term(tf: Column, df: Column, docs: Column, length: Column, avg_length: Column) -> Column:
    """One query token's part; 0 without an occurrence."""
    f = tf.cast("double")
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * (length.cast("double") / F.greatest(F.lit(1.0), avg_length)))
    return F.when(tf > 0, idf(docs, df) * (f * F.lit(K1 + 1) / (f + norm))).otherwise(F.lit(0.0))


# --- source chunks ---------------------------------------------------------------------


def _chunk_hits(query: str) -> list[tuple[str, Column, float]]:
    """(field, value of the hit or null, points) in the order in which they count."""
    low = query.lower()
    symbol = lambda t: first_with(F.col("symbols"), t, lambda s: s["name"])["name"]
    has = lambda c, t: F.lower(c).contains(t)
    hits = [("path", F.when(has("file_path", low), F.col("file_path")), EXACT_POINTS["path"]), ("symbol", symbol(low), EXACT_POINTS["symbol"]), ("content", F.when(has("content", low), snippet("content", low)), EXACT_POINTS["content"])]
    for t in query_tokens(query):
        hits += [
            ("path", F.when(has("file_path", t), F.col("file_path")), TOKEN_POINTS["path"]),
            ("symbol", symbol(t), TOKEN_POINTS["symbol"]),
            ("import", first_with(F.col("imports"), t, lambda i: i["module"])["module"], TOKEN_POINTS["import"]),
            ("export", first_with(F.col("exports"), t), TOKEN_POINTS["export"]),
            ("related_graph_node", first_with(F.col("related"), t, lambda n: F.concat_ws(" ", n["name"], n["summary"]))["id"], TOKEN_POINTS["related_graph_node"]),
        ]
    return hits


def field_points(query: str, fields: tuple[str, ...]) -> dict[str, Column]:
    """Points by field of a chunk, from its columns (file_path, symbols, imports, exports, content, related)."""
    hits = _chunk_hits(query)
    return {f: _sum([_points(v.isNotNull(), p) for g, v, p in hits if g == f]) for f in fields}


def chunk_score(breakdown: Column) -> Column:
    return _sum([breakdown[f] for f in ("bm25", *FIELDS)])


def chunk_reasons(query: str, bm25: Column) -> Column:
    """Up to eight struct(field, value, score); equal field and value are added up.

    The BM25 reason needs a token in the content and adds nothing to the score.
    """
    found = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(f).alias("field"), v.alias("value"), F.lit(p).alias("s"))) for f, v, p in _chunk_hits(query)])
    return with_values(lambda hits, words, points: _merged_reasons(hits, words, points), F.filter(found, lambda r: r.isNotNull()), tokens_in(F.col("content"), query), bm25)


def tokens_in(content: Column, query: str) -> Column:
    """The first five query tokens that the text contains."""
    tokens = F.array(*[F.lit(t) for t in query_tokens(query)]).cast("array<string>")
    return with_values(lambda low, every: F.slice(F.filter(every, lambda t: low.contains(t)), 1, 5), F.lower(content), tokens)


def _merged_reasons(found: Column, words: Column, bm25: Column) -> Column:
    keys = F.array_distinct(F.transform(found, lambda r: F.struct(r["field"].alias("field"), r["value"].alias("value"))))

    def added(k: Column) -> Column:
        own = F.filter(found, lambda r: (r["field"] == k["field"]) & (r["value"] == k["value"]))
        return F.struct((-F.aggregate(own, F.lit(0.0), lambda a, r: a + r["s"])).alias("s"), k["field"].alias("field"), k["value"].alias("value"))

    by_terms = F.when((bm25 > 0) & (F.size(words) > 0), F.array(F.struct((-bm25).alias("s"), F.lit("bm25").alias("field"), F.array_join(words, " ").alias("value")))).otherwise(F.array().cast("array<struct<s:double,field:string,value:string>>"))
    best = F.slice(F.array_sort(F.concat(F.transform(keys, added), by_terms)), 1, MAX_REASONS)
    return F.transform(best, lambda r: F.struct(r["field"].alias("field"), r["value"].alias("value"), (-r["s"]).alias("score")))


def symbol_score(name: Column, query: str) -> Column:
    """How well a symbol name answers a query: equal 100, inside the query 90, around it 80, else by tokens."""
    low, q = F.lower(name), query.lower()
    by_tokens = _sum([F.when(low == t, 50.0).when(low.contains(t), 10.0).otherwise(0.0) for t in query_tokens(query)])
    return F.when(low == q, 100.0).when(F.lit(q).contains(low), 90.0).when(low.contains(q), 80.0).otherwise(by_tokens)
