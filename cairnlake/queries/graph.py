"""Queries on the graph: lookups, lexical ranking, quality, validation, collisions and merges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairnlake.functions import keys, quality, scoring, similarity, text
from cairnlake.operators import collision, graph, retrieval, rollup, staleness, validate
from cairnlake.queries.model import ANCHORS_SQL, NODES_SQL, NOW, TOKENS_SQL, anchors, nodes, rounded_sql, table

QUESTION = "red Widget economy red"
_TOKENS = text.graph_tokens(QUESTION)


def _now():
    return F.lit(NOW).cast("timestamp")


def graph_tokenize(spark, sf_dir):
    return nodes(spark, sf_dir).select("id", F.array_join(text.graph_tokens_col("summary"), ",").alias("tokens"))


GRAPH_TOKENIZE_SQL = f"WITH {NODES_SQL} SELECT id, array_to_string([t for t in string_split_regex(lower(summary), '[ \\t\\n\\v\\f\\r]+') if t <> ''], ',') AS tokens FROM nodes"


def _points(parts: dict[str, str]) -> str:
    hit = {
        "alias": lambda t: f"len([a for a in aliases if contains(lower(a), '{t}')]) > 0",
        "name": lambda t: f"contains(lower(name), '{t}')",
        "summary": lambda t: f"contains(lower(summary), '{t}')",
        "tag": lambda t: f"len([a for a in tags if contains(lower(a), '{t}')]) > 0",
    }
    return ", ".join(f"0.0::DOUBLE + {' + '.join(f'CASE WHEN {hit[f](t)} THEN {scoring.NODE_POINTS[f]}::DOUBLE ELSE 0.0::DOUBLE END' for t in _TOKENS)} AS {name}" for f, name in parts.items())


_SCORED_SQL = f"{NODES_SQL}, parts AS (SELECT *, {_points({'alias': 's_alias', 'name': 's_name', 'summary': 's_summary', 'tag': 's_tag'})} FROM nodes WHERE status <> 'deprecated'), lex AS (SELECT *, s_alias + s_name + s_summary + s_tag AS score FROM parts)"


def graph_lexical_query(spark, sf_dir):
    best = graph.lexical_query(nodes(spark, sf_dir), QUESTION, 10)
    return best.select("id", "score", *[F.col(f"score_breakdown.{f}").alias(f"s_{f}") for f in ("alias", "name", "summary", "tag")])


LEXICAL_SQL = f"WITH {_SCORED_SQL} SELECT id, score, s_alias, s_name, s_summary, s_tag FROM lex WHERE score > 0 ORDER BY score DESC, id LIMIT 10"


def graph_match_reasons(spark, sf_dir):
    found = graph.scored_nodes(nodes(spark, sf_dir), QUESTION)
    return found.select("id", F.array_join(F.transform("match_reasons", lambda r: F.concat(r["field"], F.lit("/"), r["token"], F.lit("="), F.format_string("%.1f", r["score"]))), ";").alias("reasons"))


def _node_reasons_sql() -> str:
    hit = {"alias": "len([a for a in aliases if contains(lower(a), '{t}')]) > 0", "name": "contains(lower(name), '{t}')", "summary": "contains(lower(summary), '{t}')", "tag": "len([a for a in tags if contains(lower(a), '{t}')]) > 0"}
    rows = " UNION ALL ".join(f"SELECT id, '{f}' AS field, '{t}' AS token, {scoring.NODE_POINTS[f]} AS s, {i} AS o FROM lex WHERE score > 0 AND {cond.format(t=t)}" for i, t in enumerate(_TOKENS) for f, cond in hit.items())
    return f"WITH {_SCORED_SQL}, said AS ({rows}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, field, token) AS k FROM said) SELECT id, string_agg(field || '/' || token || '=' || printf('%.1f', s), ';' ORDER BY k) AS reasons FROM r WHERE k <= 8 GROUP BY id"


def _nation_graph(spark, sf_dir):
    """Nations lie in regions, suppliers in nations; only suppliers in the red are left out, so some ends are missing."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("from"), F.concat(F.lit("region/"), F.col("n_regionkey").cast("string")).alias("to"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("from"), F.concat(F.lit("nation/"), F.col("s_nationkey").cast("string")).alias("to"))
    edges = n.unionByName(s).withColumn("kind", F.lit("depends_on")).withColumn("note", F.lit(None).cast("string"))
    ids = table(spark, sf_dir, "region").select(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("id"))
    ids = ids.union(table(spark, sf_dir, "nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")))).union(table(spark, sf_dir, "supplier").where("s_acctbal >= 1000").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string"))))
    return edges, ids


_EDGES_SQL = "edges AS (SELECT 'nation/' || n_nationkey AS f, 'region/' || n_regionkey AS t FROM nation UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier), ids AS (SELECT 'region/' || r_regionkey AS id FROM region UNION ALL SELECT 'nation/' || n_nationkey FROM nation UNION ALL SELECT 'supplier/' || s_suppkey FROM supplier WHERE s_acctbal >= 1000)"


def induced_edges(spark, sf_dir):
    edges, ids = _nation_graph(spark, sf_dir)
    return graph.induced_edges(edges, ids).select("from", "to", "kind")


INDUCED_SQL = f'WITH {_EDGES_SQL} SELECT f AS "from", t AS "to", \'depends_on\' AS kind FROM edges WHERE f IN (SELECT id FROM ids) AND t IN (SELECT id FROM ids)'


def dangling_edges(spark, sf_dir):
    edges, ids = _nation_graph(spark, sf_dir)
    return validate.dangling_edges(edges, ids)


DANGLING_SQL = f"WITH {_EDGES_SQL}, ends AS (SELECT f || '|' || t || '|depends_on' AS edge_key, unnest([f, t]) AS missing_endpoint FROM edges) SELECT edge_key, missing_endpoint FROM ends WHERE missing_endpoint NOT IN (SELECT id FROM ids)"


def repair_graph(spark, sf_dir):
    edges, ids = _nation_graph(spark, sf_dir)
    tagged = nodes(spark, sf_dir)
    topics = tagged.where("status = 'active' and kind = 'flow'").select(F.explode("tags").alias("name")).distinct().select("name", _now().alias("created_at"), F.lit(False).alias("auto_created"))
    kept = validate.without_dangling(edges, ids).select(keys.edge_key(F.col("from"), F.col("to"), F.col("kind")).alias("item"), F.lit("edge").alias("what"))
    filled = graph.ensure_topics(topics, validate.missing_topics(tagged, topics).select(F.col("topic").alias("name")), _now())
    return kept.unionByName(filled.select(F.col("name").alias("item"), F.when(F.col("auto_created"), "topic added").otherwise("topic").alias("what")))


REPAIR_SQL = f"""
WITH {_EDGES_SQL}, {NODES_SQL}, topics AS (SELECT DISTINCT unnest(tags) AS name FROM nodes WHERE status = 'active' AND kind = 'flow')
SELECT f || '|' || t || '|depends_on' AS item, 'edge' AS what FROM edges WHERE f IN (SELECT id FROM ids) AND t IN (SELECT id FROM ids)
UNION ALL SELECT name, 'topic' FROM topics
UNION ALL SELECT DISTINCT tag, 'topic added' FROM (SELECT unnest(tags) AS tag FROM nodes) WHERE tag NOT IN (SELECT name FROM topics)"""


def missing_topics(spark, sf_dir):
    tagged = nodes(spark, sf_dir)
    topics = tagged.where("kind = 'flow'").select(F.explode("tags").alias("name")).where("name like 'Brand%'").distinct()
    return validate.missing_topics(tagged, topics)


MISSING_SQL = f"WITH {NODES_SQL}, topics AS (SELECT DISTINCT unnest(tags) AS name FROM nodes WHERE kind = 'flow') SELECT topic, node_id FROM (SELECT unnest(tags) AS topic, id AS node_id FROM nodes) WHERE topic NOT IN (SELECT name FROM topics WHERE name LIKE 'Brand%')"


def duplicate_aliases(spark, sf_dir):
    return validate.duplicate_aliases(nodes(spark, sf_dir)).select("alias", F.size("node_ids").alias("owners"), F.sha2(F.array_join("node_ids", ","), 256).alias("node_ids"))


DUPLICATE_SQL = f"WITH {NODES_SQL} SELECT alias, CAST(count(*) AS INTEGER) AS owners, sha256(string_agg(id, ',' ORDER BY map_pos)) AS node_ids FROM (SELECT id, map_pos, unnest(aliases) AS alias FROM nodes) GROUP BY alias HAVING count(*) > 1"


def node_by_alias(spark, sf_dir):
    rows = nodes(spark, sf_dir)
    by_alias, by_id = graph.get_node(rows, "red widget economy"), graph.get_node(rows, "part/7")
    return by_alias.unionByName(by_id).select("id", "name", "kind", "map_pos")


ALIAS_SQL = f"WITH {NODES_SQL} SELECT id, name, kind, map_pos FROM (SELECT * FROM nodes WHERE list_contains(aliases, 'red widget economy') ORDER BY map_pos LIMIT 1) UNION ALL SELECT id, name, kind, map_pos FROM nodes WHERE id = 'part/7'"


def resolve_keys(spark, sf_dir):
    rows = nodes(spark, sf_dir)
    return graph.resolve_ids(rows.select(F.explode("aliases").alias("key")), rows)


RESOLVE_SQL = f"WITH {NODES_SQL}, a AS (SELECT unnest(aliases) AS key, id, map_pos FROM nodes) SELECT key, arg_min(id, map_pos) AS id FROM a GROUP BY key"


def incident_edges(spark, sf_dir):
    edges, _ = _nation_graph(spark, sf_dir)
    return graph.incident_edges(edges, "nation/3").select("from", "to", "kind")


INCIDENT_SQL = f'WITH {_EDGES_SQL} SELECT f AS "from", t AS "to", \'depends_on\' AS kind FROM edges WHERE f = \'nation/3\' OR t = \'nation/3\''


def list_active_nodes(spark, sf_dir):
    return graph.list_nodes(nodes(spark, sf_dir)).select("id", "kind", "name", "summary")


LIST_SQL = f"WITH {NODES_SQL} SELECT id, kind, name, summary FROM nodes WHERE status <> 'deprecated'"


def knowledge_highlights(spark, sf_dir):
    return graph.knowledge_nodes(nodes(spark, sf_dir), ("decision", "gotcha", "invariant")).select("id", "kind", "name")


HIGHLIGHTS_SQL = f"WITH {NODES_SQL} SELECT id, kind, name FROM nodes WHERE status <> 'deprecated' AND kind IN ('decision', 'gotcha', 'invariant') ORDER BY id LIMIT 12"


def related_nodes_join(spark, sf_dir):
    found = retrieval.related_nodes(nodes(spark, sf_dir), anchors(spark, sf_dir))
    return found.select("file_path", F.size("related").alias("n"), F.array_join(F.transform("related", lambda r: r["id"]), ",").alias("ids"))


RELATED_SQL = f"WITH {NODES_SQL}, {ANCHORS_SQL}, p AS (SELECT DISTINCT file_path, node_id FROM anchors) SELECT file_path, CAST(count(*) AS INTEGER) AS n, string_agg(id, ',' ORDER BY map_pos) AS ids FROM p JOIN nodes ON id = node_id GROUP BY file_path"


def edge_key_parse(spark, sf_dir):
    edges, _ = _nation_graph(spark, sf_dir)
    made = edges.select(keys.edge_key(F.col("from"), F.col("to"), F.col("kind")).alias("key")).union(edges.select(F.concat_ws("|", "from", "to", F.lit("likes"))))
    return made.select("key", keys.parse_edge_key(F.col("key")).alias("k")).select("key", "k.from", "k.to", "k.kind")


EDGE_KEY_SQL = f"WITH {_EDGES_SQL} SELECT f || '|' || t || '|depends_on' AS key, f AS \"from\", t AS \"to\", 'depends_on' AS kind FROM edges UNION ALL SELECT f || '|' || t || '|likes', NULL, NULL, NULL FROM edges"


# --- staleness and quality ---------------------------------------------------------------


def _status(spark, sf_dir):
    """Anchors of parts: the range hash holds the ship date's year, the current one the order date's."""
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("file_path"), F.col("o_orderstatus").alias("st"), F.year("o_orderdate").cast("string").alias("now_hash"), F.lit(True).alias("there"))
    rows = anchors(spark, sf_dir).join(orders.where("st <> 'P'"), "file_path", "left").withColumn("range_hash", F.when(F.col("start_line") <= 4, F.year("seen").cast("string")))
    why = staleness.reason(F.lit(False), F.col("there").isNull(), F.lit(False), F.col("range_hash"), F.col("now_hash"), F.lit("O"), F.col("st"))
    return rows.withColumn("reason", why)


_STATUS_SQL = f"{ANCHORS_SQL}, status AS (SELECT a.*, CASE WHEN o.o_orderkey IS NULL THEN 'missing' WHEN start_line <= 4 AND CAST(year(seen) AS VARCHAR) <> CAST(year(o_orderdate) AS VARCHAR) THEN 'anchor_changed' WHEN start_line > 4 AND o_orderstatus <> 'O' THEN 'changed' END AS reason FROM anchors a LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON a.file_path = 'orders/' || o.o_orderkey)"


def staleness_by_reason(spark, sf_dir):
    return _status(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("fresh")).alias("reason")).agg(F.count(F.lit(1)).alias("anchors"), F.countDistinct("node_id").alias("nodes"))


BY_REASON_SQL = f"WITH {_STATUS_SQL} SELECT coalesce(reason, 'fresh') AS reason, count(*) AS anchors, count(DISTINCT node_id) AS nodes FROM status GROUP BY 1"


def staleness_classify(spark, sf_dir):
    """Anchors into documents: hashes of the stored text against the text in lower case as the current file."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), "text", "doc_id", "lang", "source")
    stored = docs.select(F.col("doc_id").cast("string").alias("node_id"), F.lit(0).alias("pos"), F.when(F.col("lang") == "es", F.concat(F.lit("../"), "file_path")).otherwise(F.col("file_path")).alias("file_path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), text.sha256("text").alias("content_hash"), F.when(F.col("lang") != "de", text.range_hash(F.lower("text"), F.lit(1), F.lit(2))).alias("range_hash"))
    current = docs.where("source <> 'src3'").select("file_path", F.when(F.col("source") == "src4", F.col("text")).otherwise(F.lower("text")).alias("content"))
    return staleness.classify(stored, current).select("node_id", "reason", "range_fresh")


CLASSIFY_SQL = """
WITH d AS (SELECT *, string_split_regex(text, '\\r?\\n') AS l, string_split_regex(lower(text), '\\r?\\n') AS m FROM documents),
c AS (SELECT doc_id, lang, source, text, array_to_string(m[1:2], chr(10)) AS kept, array_to_string(CASE WHEN source = 'src4' THEN l ELSE m END[1:2], chr(10)) AS now_range, CASE WHEN source = 'src4' THEN text ELSE lower(text) END AS now FROM d)
SELECT CAST(doc_id AS VARCHAR) AS node_id,
       CASE WHEN lang = 'es' THEN 'unsafe_path' WHEN source = 'src3' THEN 'missing' WHEN lang <> 'de' AND kept <> now_range THEN 'anchor_changed' WHEN lang = 'de' AND text <> now THEN 'changed' END AS reason,
       lang NOT IN ('es', 'de') AND source <> 'src3' AND kept = now_range AND text <> now AS range_fresh
FROM c"""


def health_summary(spark, sf_dir):
    status = _status(spark, sf_dir)
    rows = nodes(spark, sf_dir)
    n = lambda r: F.count_if(F.col("reason") == r).alias(f"{r}_sources")
    own = status.agg(F.count(F.lit(1)).alias("checked_sources"), F.count("reason").alias("stale_sources"), n("anchor_changed"), n("changed"), n("missing"))
    total = rows.agg(F.count(F.lit(1)).alias("total_nodes"), F.count_if(F.col("status") == "active").alias("active_nodes"))
    both = own.join(F.broadcast(total), how="cross")
    return both.withColumn("reported", F.least("stale_sources", F.lit(50))).withColumn("truncated", F.col("stale_sources") > 50).withColumn("fresh", F.col("stale_sources") == 0)


HEALTH_SQL = f"WITH {NODES_SQL}, {_STATUS_SQL} SELECT count(*) AS checked_sources, count(reason) AS stale_sources, count(*) FILTER (reason = 'anchor_changed') AS anchor_changed_sources, count(*) FILTER (reason = 'changed') AS changed_sources, count(*) FILTER (reason = 'missing') AS missing_sources, (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM nodes WHERE status = 'active') AS active_nodes, CAST(least(count(reason), 50) AS BIGINT) AS reported, count(reason) > 50 AS truncated, count(reason) = 0 AS fresh FROM status"


def _scored(spark, sf_dir):
    per_node = _status(spark, sf_dir).groupBy("node_id").agg(F.count(F.lit(1)).alias("n_sources"), F.count("reason").alias("stale"), F.max("seen").alias("verified"))
    rows = nodes(spark, sf_dir).join(per_node, F.col("id") == F.col("node_id"), "left").fillna(0, ["n_sources", "stale"])
    rows = rows.withColumn("freshness", quality.freshness(F.lit(True), F.col("n_sources"), F.col("stale"))).withColumn("age_days", quality.age_days(F.col("verified"), _now()))
    rows = rows.withColumn("quality", quality.score(F.col("confidence"), quality.freshness_factor(F.col("freshness"), F.col("n_sources"), F.col("stale")), F.col("age_days"), F.col("kind"), F.col("status")))
    return rows.withColumn("trust", quality.trust(F.col("status"), F.col("freshness"), F.col("confidence"), F.col("quality")))


_kind_sql = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in quality.KIND_FACTORS.items()) + " ELSE 0.8::DOUBLE END"
_QUALITY_SQL = f"""{NODES_SQL}, {_STATUS_SQL}, per AS (SELECT node_id, count(*) AS n_sources, count(reason) AS stale, max(seen) AS verified FROM status GROUP BY node_id),
q0 AS (SELECT n.*, coalesce(n_sources, 0) AS n_sources, coalesce(stale, 0) AS stale, CASE WHEN verified IS NULL THEN NULL ELSE greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(verified)) / 86400000000.0::DOUBLE, 0.0::DOUBLE) END AS age_days FROM nodes n LEFT JOIN per ON id = node_id),
q1 AS (SELECT *, CASE WHEN n_sources = 0 THEN 'no_sources' WHEN stale > 0 THEN 'stale' ELSE 'fresh' END AS freshness FROM q0),
q2 AS (SELECT *, 0.35::DOUBLE * least(greatest(confidence, 0.0::DOUBLE), 1.0::DOUBLE) + 0.25::DOUBLE * (CASE freshness WHEN 'fresh' THEN 1.0::DOUBLE WHEN 'no_sources' THEN 0.62::DOUBLE ELSE least(greatest(1.0::DOUBLE - 0.7::DOUBLE * (stale::DOUBLE / greatest(n_sources, 1)), 0.3::DOUBLE), 0.75::DOUBLE) END)
 + 0.2::DOUBLE * (CASE WHEN age_days IS NULL THEN 0.72::DOUBLE WHEN age_days <= 30 THEN 1.0::DOUBLE WHEN age_days <= 180 THEN 0.92::DOUBLE WHEN age_days <= 365 THEN 0.82::DOUBLE WHEN age_days <= 730 THEN 0.72::DOUBLE ELSE 0.62::DOUBLE END)
 + 0.1::DOUBLE * {_kind_sql} + 0.1::DOUBLE * (CASE WHEN status = 'deprecated' THEN 0.35::DOUBLE ELSE 1.0::DOUBLE END) AS raw FROM q1),
q3 AS (SELECT *, {rounded_sql("raw")} AS quality FROM q2),
scored_nodes AS (SELECT *, CASE WHEN status = 'deprecated' OR freshness = 'stale' OR confidence < 0.55 OR quality < 0.62 THEN 'low' WHEN freshness = 'fresh' AND confidence >= 0.8 AND quality >= 0.82 THEN 'high' ELSE 'medium' END AS trust FROM q3)"""


def quality_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "freshness", "quality", "trust")


QUALITY_SQL = f"WITH {_QUALITY_SQL} SELECT id, freshness, quality, trust FROM scored_nodes"


def trust_tiers(spark, sf_dir):
    tier = F.explode(F.array_compact(F.array(F.col("trust"), F.when(F.col("freshness") == "stale", "stale"))))
    return _scored(spark, sf_dir).select(tier.alias("tier"), "id").groupBy("tier").agg(F.count(F.lit(1)).alias("nodes"), F.min("id").alias("first"), F.max("id").alias("last"))


TIERS_SQL = f"WITH {_QUALITY_SQL}, t AS (SELECT trust AS tier, id FROM scored_nodes UNION ALL SELECT 'stale', id FROM scored_nodes WHERE freshness = 'stale') SELECT tier, count(*) AS nodes, min(id) AS first, max(id) AS last FROM t GROUP BY tier"


def quality_reasons(spark, sf_dir):
    s = _scored(spark, sf_dir)
    said = quality.reasons(F.floor(F.col("confidence") * 4) / 4, F.col("freshness"), F.col("stale"), F.col("n_sources"), F.col("age_days"), F.col("kind"), F.col("status"), F.col("trust"))
    return s.select("id", F.array_join(said, "; ").alias("reasons"))


REASONS_SQL = f"""WITH {_QUALITY_SQL} SELECT id, array_to_string([x for x in [
 'confidence=' || printf('%.2f', floor(confidence * 4) / 4),
 'anchors=' || CASE freshness WHEN 'stale' THEN 'stale:' || stale || '/' || n_sources ELSE freshness END,
 'age_days=' || coalesce(CAST(CAST(floor(age_days + 0.5) AS BIGINT) AS VARCHAR), 'unknown'),
 CASE WHEN kind IN ('decision', 'gotcha', 'invariant') THEN 'planning=' || kind END,
 CASE WHEN status = 'deprecated' THEN 'status=deprecated' END,
 CASE WHEN trust = 'low' THEN 'trust=low' END] if x IS NOT NULL], '; ') AS reasons FROM scored_nodes"""


def quality_rerank(spark, sf_dir):
    from cairnlake.plans.query_graph import over_fetch

    limit = 10
    best = graph.lexical_query(nodes(spark, sf_dir), QUESTION, over_fetch(limit)).select("id", "score")
    rows = best.join(_scored(spark, sf_dir).select("id", "quality", "trust"), "id").withColumn("ranking", quality.ranking(F.col("score"), F.col("quality")))
    return rows.orderBy(F.desc("ranking"), F.desc("score"), F.desc("quality"), "id").limit(limit)


RERANK_SQL = f"WITH {_QUALITY_SQL}, parts AS (SELECT *, {_points({'alias': 's_alias', 'name': 's_name', 'summary': 's_summary', 'tag': 's_tag'})} FROM nodes WHERE status <> 'deprecated'), best AS (SELECT id, s_alias + s_name + s_summary + s_tag AS score FROM parts WHERE s_alias + s_name + s_summary + s_tag > 0 ORDER BY 2 DESC, id LIMIT 30), r AS (SELECT id, score, quality, trust, {rounded_sql('score * (0.35::DOUBLE + quality)')} AS ranking FROM best JOIN scored_nodes USING (id)) SELECT * FROM r ORDER BY ranking DESC, score DESC, quality DESC, id LIMIT 10"


# --- similarity and collisions --------------------------------------------------------------


def dice_pairs(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("s")).distinct()
    return collision.similar_strings(names, names, 0.3, ordered=True).select("a", "b", text.rounded("dice").alias("dice"))


_GRAMS = "list_distinct([substr(lower({0}), i, 2) for i in range(1, length({0}))])"
DICE_SQL = f"WITH n AS (SELECT DISTINCT p_name AS s, {_GRAMS.format('p_name')} AS g FROM part), p AS (SELECT x.s AS a, y.s AS b, 2.0::DOUBLE * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g)) AS d FROM n x, n y WHERE x.s < y.s) SELECT a, b, {rounded_sql('d')} AS dice FROM p WHERE d >= 0.3"


def similar_words(spark, sf_dir):
    """Pairs of different tokens of documents, of twelve characters or more, with Dice of 0.8 or more."""
    words = text.long_tokens(table(spark, sf_dir, "documents"), "text", 12)
    return collision.similar_strings(words, words, 0.8, ordered=True).select("a", "b", text.rounded("dice").alias("dice"))


WORDS_SQL = f"WITH n AS (SELECT s, {_GRAMS.format('s')} AS g FROM (SELECT DISTINCT unnest({TOKENS_SQL.format('text')}) AS s FROM documents) WHERE length(s) >= 12), p AS (SELECT x.s AS a, y.s AS b, 2.0::DOUBLE * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g)) AS d FROM n x JOIN n y ON x.s < y.s AND 3 * least(len(x.g), len(y.g)) >= 2 * greatest(len(x.g), len(y.g))) SELECT a, b, {rounded_sql('d')} AS dice FROM p WHERE d >= 0.8::DOUBLE"


def tag_jaccard(spark, sf_dir):
    """Of the tags of consecutive parts."""
    w = W.partitionBy("kind").orderBy("map_pos")
    rows = nodes(spark, sf_dir).withColumn("before", F.lag("tags").over(w)).where("before is not null")
    return rows.select("id", text.rounded(similarity.tag_overlap(F.col("tags"), F.col("before"))).alias("jaccard"))


TAG_SQL = f"WITH {NODES_SQL}, p AS (SELECT id, tags, lag(tags) OVER (PARTITION BY kind ORDER BY map_pos) AS before FROM nodes) SELECT id, {rounded_sql('len(list_intersect(tags, before))::DOUBLE / len(list_distinct(list_concat(tags, before)))')} AS jaccard FROM p WHERE before IS NOT NULL"


def _sources(spark, sf_dir):
    """Anchors of each part: supplier as file, lines from the line number on."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("id"), F.struct(F.col("l_suppkey").cast("string").alias("file_path"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + F.col("l_quantity")).cast("int").alias("end_line")).alias("s"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("sources"))


def source_overlap(spark, sf_dir):
    w = W.partitionBy("kind").orderBy("map_pos")
    rows = nodes(spark, sf_dir).join(_sources(spark, sf_dir), "id").withColumn("before", F.lag("sources").over(w)).where("before is not null")
    return rows.select("id", text.rounded(similarity.source_overlap(F.col("sources"), F.col("before"))).alias("overlap"))


_SOURCES_SQL = "src AS (SELECT 'part/' || l_partkey AS id, list({'f': CAST(l_suppkey AS VARCHAR), 's': l_linenumber, 'e': CAST(l_linenumber + l_quantity AS INTEGER)}) AS sources FROM lineitem GROUP BY 1)"
OVERLAP_SQL = f"""
WITH {NODES_SQL}, {_SOURCES_SQL}, p AS (SELECT id, sources AS a, lag(sources) OVER (PARTITION BY kind ORDER BY map_pos) AS b FROM nodes JOIN src USING (id)),
m AS (SELECT id, bool_or(x.f = y.f AND x.s <= y.e AND y.s <= x.e) AS meets FROM (SELECT id, unnest(a) AS x, b FROM p WHERE b IS NOT NULL), unnest(b) AS u(y) GROUP BY id),
j AS (SELECT id, list_distinct([x.f for x in a]) AS fa, list_distinct([y.f for y in b]) AS fb FROM p WHERE b IS NOT NULL)
SELECT id, {rounded_sql("least(len(list_intersect(fa, fb))::DOUBLE / len(list_distinct(list_concat(fa, fb))) + CASE WHEN meets THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE)")} AS overlap FROM j JOIN m USING (id)"""


def collisions_topk(spark, sf_dir):
    """Each distinct name of parts against all others: the name's tags are its brands and types in order."""
    rows = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"), F.array_sort(F.collect_set("p_type")).alias("tags"))
    n = rows.select(F.col("p_name").alias("id"), F.col("p_name").alias("name"), F.array().cast("array<struct<file_path:string,start_line:int,end_line:int>>").alias("sources"), "tags", F.array(F.reverse("p_name")).alias("aliases"), F.col("k").cast("int").alias("map_pos"))
    found = collision.find_collisions(n, n, threshold=0.55, top=3)
    return found.select("id", "candidate", text.rounded("similarity").alias("similarity"), "rank")


COLLISION_SQL = f"""
WITH n AS (SELECT p_name AS id, min(p_partkey) AS k, list_distinct(list(p_type)) AS tags, {_GRAMS.format("p_name")} AS g, {_GRAMS.format("reverse(p_name)")} AS h FROM part GROUP BY p_name),
p AS (SELECT x.id, y.id AS candidate, y.k, 0.5::DOUBLE * greatest(2.0::DOUBLE * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g)), 2.0::DOUBLE * len(list_intersect(x.g, y.h)) / (len(x.g) + len(y.h))) + 0.25::DOUBLE * 0.0::DOUBLE + 0.25::DOUBLE * (len(list_intersect(x.tags, y.tags))::DOUBLE / len(list_distinct(list_concat(x.tags, y.tags)))) AS s FROM n x, n y WHERE x.id <> y.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, k) AS rank FROM p WHERE s >= 0.55)
SELECT id, candidate, {rounded_sql("s")} AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""


# --- writes -----------------------------------------------------------------------------------


def _merge_sides(spark, sf_dir):
    """Existing: small parts. Incoming: parts of medium size under the id of the part one below."""
    full = nodes(spark, sf_dir).withColumn("sources", F.array().cast("array<struct<file_path:string,start_line:int,end_line:int,content_hash:string,range_hash:string>>")).withColumn("last_verified_at", _now())
    size = table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("id"), "p_size")
    sized = full.join(size, "id")
    return sized.where("p_size <= 30").drop("p_size"), sized.where("p_size > 10").withColumn("target", F.concat(F.lit("part/"), (F.col("map_pos") - 1).cast("string"))).drop("p_size")


def upsert_merge(spark, sf_dir):
    old, new = _merge_sides(spark, sf_dir)
    merged = graph.upsert_nodes(old, new, active_topic="merge")
    return merged.select("id", "kind", "name", "summary", F.array_join("tags", ",").alias("tags"), F.array_join("aliases", ",").alias("aliases"), "status", "confidence")


def upsert_in_order(spark, sf_dir):
    """Parts by size and key folded into one node for each brand; the smallest parts are there already, by brand."""
    every = nodes(spark, sf_dir).withColumn("sources", F.array().cast("array<struct<file_path:string,start_line:int,end_line:int,content_hash:string,range_hash:string>>")).withColumn("last_verified_at", _now())
    rows = every.withColumn("target", F.regexp_extract("summary", "Brand#[0-9]+", 0))
    old = rows.groupBy("target").agg(F.min_by(F.struct(*every.columns), "map_pos").alias("n")).select("n.*", F.col("target").alias("t")).drop("id").withColumnRenamed("t", "id")
    merged = graph.upsert_nodes(old.select(*every.columns), rows, active_topic="merge", order_col="map_pos")
    return merged.select("id", "kind", "name", "summary", F.array_join("tags", ",").alias("tags"), F.size("aliases").alias("n_aliases"), "status", "confidence")


IN_ORDER_SQL = f"""
WITH {NODES_SQL}, r AS (SELECT *, regexp_extract(summary, 'Brand#[0-9]+') AS t FROM nodes),
e AS (SELECT t, x, min(struct_pack(p := map_pos, i := i)) AS spot FROM (SELECT t, map_pos, tags[i] AS x, i FROM r, range(1, 3) q(i)) GROUP BY t, x),
tagged AS (SELECT t, x, spot FROM e UNION ALL SELECT t, 'merge', struct_pack(p := min(map_pos), i := 9::BIGINT) AS spot FROM r GROUP BY t)
SELECT t AS id, arg_min(kind, map_pos) AS kind, arg_min(name, map_pos) AS name, arg_max(summary, struct_pack(c := confidence, p := map_pos)) AS summary,
 (SELECT string_agg(x, ',' ORDER BY spot) FROM tagged WHERE tagged.t = r.t) AS tags, CAST(count(DISTINCT aliases[1]) AS INTEGER) AS n_aliases, arg_max(status, map_pos) AS status, max(confidence) AS confidence
FROM r GROUP BY t"""

UPSERT_SQL = f"""
WITH {NODES_SQL}, sized AS (SELECT nodes.*, p_size, p_partkey FROM nodes JOIN part ON id = 'part/' || p_partkey),
o AS (SELECT * FROM sized WHERE p_size <= 30), n AS (SELECT *, 'part/' || (p_partkey - 1) AS target FROM sized WHERE p_size > 10)
SELECT coalesce(o.id, n.target) AS id, coalesce(o.kind, n.kind) AS kind, coalesce(o.name, n.name) AS name,
 CASE WHEN o.id IS NULL OR n.confidence >= o.confidence THEN n.summary ELSE o.summary END AS summary,
 array_to_string(CASE WHEN n.id IS NULL THEN o.tags WHEN o.id IS NULL THEN list_append(n.tags, 'merge') ELSE list_append(list_concat(o.tags, [t for t in n.tags if NOT list_contains(o.tags, t)]), 'merge') END, ',') AS tags,
 array_to_string(CASE WHEN n.id IS NULL THEN o.aliases WHEN o.id IS NULL THEN n.aliases ELSE list_concat(o.aliases, [t for t in n.aliases if NOT list_contains(o.aliases, t)]) END, ',') AS aliases,
 coalesce(n.status, o.status) AS status, CASE WHEN n.id IS NULL THEN o.confidence WHEN o.id IS NULL OR n.confidence >= o.confidence THEN n.confidence ELSE o.confidence END AS confidence
FROM o FULL OUTER JOIN n ON o.id = n.target"""
UPSERT_SQL = UPSERT_SQL.replace("CASE WHEN o.id IS NULL OR n.confidence >= o.confidence THEN n.summary", "CASE WHEN n.id IS NULL THEN o.summary WHEN o.id IS NULL OR n.confidence >= o.confidence THEN n.summary")


def edge_upsert(spark, sf_dir):
    edges, _ = _nation_graph(spark, sf_dir)
    noted = edges.withColumn("note", F.col("to"))
    fresh = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("from"), F.concat(F.lit("nation/"), F.col("s_nationkey").cast("string")).alias("to"), F.when(F.col("s_acctbal") < 1000, "replaces").otherwise("depends_on").alias("kind"), F.when(F.col("s_acctbal") > 5000, "rich").alias("note"))
    return graph.ensure_edges(noted, fresh)


EDGE_UPSERT_SQL = f"""
WITH {_EDGES_SQL}, old AS (SELECT f, t, 'depends_on' AS kind, t AS note FROM edges),
new AS (SELECT 'supplier/' || s_suppkey AS f, 'nation/' || s_nationkey AS t, CASE WHEN s_acctbal < 1000 THEN 'replaces' ELSE 'depends_on' END AS kind, CASE WHEN s_acctbal > 5000 THEN 'rich' END AS note FROM supplier)
SELECT coalesce(old.f, new.f) AS "from", coalesce(old.t, new.t) AS "to", coalesce(old.kind, new.kind) AS kind, coalesce(new.note, old.note) AS note FROM old FULL OUTER JOIN new ON old.f = new.f AND old.t = new.t AND old.kind = new.kind"""


def topic_upsert(spark, sf_dir):
    rows = nodes(spark, sf_dir)
    topics = rows.where("kind = 'flow'").select(F.element_at("tags", 1).alias("name")).distinct().select("name", _now().alias("created_at"), F.lit(False).alias("auto_created"))
    return graph.ensure_topics(topics, rows.select(F.explode("tags").alias("name")), _now()).select("name", "auto_created")


TOPIC_SQL = f"WITH {NODES_SQL}, topics AS (SELECT DISTINCT tags[1] AS name FROM nodes WHERE kind = 'flow') SELECT name, false AS auto_created FROM topics UNION ALL SELECT DISTINCT t, true FROM (SELECT unnest(tags) AS t FROM nodes) WHERE t NOT IN (SELECT name FROM topics)"


def override_patch(spark, sf_dir):
    rows = nodes(spark, sf_dir).withColumn("last_verified_at", F.lit("2000-01-01 00:00:00").cast("timestamp"))
    return graph.override(rows, "part/7", {"name": F.lit("patched"), "confidence": F.lit(0.5)}, _now()).select("id", "name", "confidence", F.date_format("last_verified_at", "yyyy-MM-dd").alias("verified"))


OVERRIDE_SQL = f"WITH {NODES_SQL} SELECT id, CASE WHEN id = 'part/7' THEN 'patched' ELSE name END AS name, CASE WHEN id = 'part/7' THEN 0.5::DOUBLE ELSE confidence END AS confidence, CASE WHEN id = 'part/7' THEN '2001-12-01' ELSE '2000-01-01' END AS verified FROM nodes"


def tags_add_remove(spark, sf_dir):
    return nodes(spark, sf_dir).select("id", F.array_join(graph.changed_set(F.col("tags"), ["ECONOMY", "new"], ["STANDARD", "new2"]), ",").alias("tags"))


TAGS_SQL = f"WITH {NODES_SQL} SELECT id, array_to_string([t for t in list_concat(tags, [x for x in ['ECONOMY', 'new'] if NOT list_contains(tags, x)]) if t NOT IN ('STANDARD', 'new2')], ',') AS tags FROM nodes"


def deprecate_reason(spark, sf_dir):
    rows = nodes(spark, sf_dir).withColumn("last_verified_at", _now())
    return graph.deprecate(rows, "part/7", _now(), "superseded").select("id", "status", "summary")


DEPRECATE_SQL = f"WITH {NODES_SQL}, k AS (SELECT 'part/7' AS id) SELECT id, CASE WHEN id = (SELECT id FROM k) THEN 'deprecated' ELSE status END AS status, CASE WHEN id = (SELECT id FROM k) THEN '[deprecated: superseded] ' || summary ELSE summary END AS summary FROM nodes"


def weekly_rollup(spark, sf_dir):
    from cairnlake.queries.changes import turns

    stamped = nodes(spark, sf_dir).join(anchors(spark, sf_dir).groupBy("node_id").agg(F.max("seen").alias("last_verified_at")), F.col("id") == F.col("node_id"), "left")
    now = F.lit("2024-01-28 00:00:00").cast("timestamp")
    both = rollup.node_stats(stamped, F.lit("2001-10-20 00:00:00").cast("timestamp")).join(F.broadcast(rollup.turn_stats(turns(spark, sf_dir), now)), how="cross")
    return both.select(rollup.iso_week(now).alias("week_of"), "total_nodes", rollup.share(F.col("verified"), F.col("total_nodes")).alias("verified_pct_7d"), rollup.share(F.col("knowledge"), F.col("total_nodes")).alias("knowledge_kind_ratio"), "total_emissions", "total_collisions", "cap_hits")


REGISTRY = {
    "graph_tokenize": (graph_tokenize, GRAPH_TOKENIZE_SQL),
    "graph_lexical_query": (graph_lexical_query, LEXICAL_SQL),
    "graph_match_reasons": (graph_match_reasons, _node_reasons_sql()),
    "induced_edges": (induced_edges, INDUCED_SQL),
    "dangling_edges": (dangling_edges, DANGLING_SQL),
    "repair_graph": (repair_graph, REPAIR_SQL),
    "missing_topics": (missing_topics, MISSING_SQL),
    "duplicate_aliases": (duplicate_aliases, DUPLICATE_SQL),
    "node_by_alias": (node_by_alias, ALIAS_SQL),
    "resolve_keys": (resolve_keys, RESOLVE_SQL),
    "incident_edges": (incident_edges, INCIDENT_SQL),
    "list_active_nodes": (list_active_nodes, LIST_SQL),
    "knowledge_highlights": (knowledge_highlights, HIGHLIGHTS_SQL),
    "related_nodes_join": (related_nodes_join, RELATED_SQL),
    "edge_key_parse": (edge_key_parse, EDGE_KEY_SQL),
    "staleness_classify": (staleness_classify, CLASSIFY_SQL),
    "staleness_by_reason": (staleness_by_reason, BY_REASON_SQL),
    "health_summary": (health_summary, HEALTH_SQL),
    "quality_score": (quality_score, QUALITY_SQL),
    "trust_tiers": (trust_tiers, TIERS_SQL),
    "quality_reasons": (quality_reasons, REASONS_SQL),
    "quality_rerank": (quality_rerank, RERANK_SQL),
    "dice_pairs": (dice_pairs, DICE_SQL),
    "tag_jaccard": (tag_jaccard, TAG_SQL),
    "source_overlap": (source_overlap, OVERLAP_SQL),
    "similar_words": (similar_words, WORDS_SQL),
    "collisions_topk": (collisions_topk, COLLISION_SQL),
    "upsert_in_order": (upsert_in_order, IN_ORDER_SQL),
    "upsert_merge": (upsert_merge, UPSERT_SQL),
    "edge_upsert": (edge_upsert, EDGE_UPSERT_SQL),
    "topic_upsert": (topic_upsert, TOPIC_SQL),
    "override_patch": (override_patch, OVERRIDE_SQL),
    "tags_add_remove": (tags_add_remove, TAGS_SQL),
    "deprecate_reason": (deprecate_reason, DEPRECATE_SQL),
}
