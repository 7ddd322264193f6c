"""Queries on changes, dependencies, the activity log and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions import predicates, text
from cairnlake.operators import changes, deps, intervals, rollup, staleness, writeback
from cairnlake.queries.model import DOCUMENTS_SQL, documents, rounded_sql, table, turn_names

# --- activity log ------------------------------------------------------------------------


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def turns(spark, sf_dir):
    counted = rollup.turn_counters(_events(spark, sf_dir), user="user_id", ts="ts", kind="event_type", opens="signup", names=turn_names())
    return counted.select("user_id", "turn", F.col("started").alias("ts"), *turn_names(), (F.col("nodes_emitted") > rollup.TURN_CAP).alias("cap_hit"))


_TURNS_SQL = "numbered AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM events), turns AS (SELECT user_id, CAST(turn AS BIGINT) AS turn, min(ts) AS ts, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {n}" for n, k in turn_names().items()) + ", count(*) FILTER (event_type = 'purchase') > 5 AS cap_hit FROM numbered WHERE turn > 0 GROUP BY user_id, turn)"


def turn_counters(spark, sf_dir):
    return turns(spark, sf_dir).select("user_id", "turn", *turn_names(), "cap_hit")


TURN_SQL = f"WITH {_TURNS_SQL} SELECT user_id, turn, {', '.join(turn_names())}, cap_hit FROM turns"


def newest_turns(spark, sf_dir):
    rows = rollup.newest_turns(turns(spark, sf_dir), order=[F.desc("ts"), F.col("user_id")])
    return rows.select("user_id", "turn")


NEWEST_SQL = f"WITH {_TURNS_SQL} SELECT user_id, turn FROM turns ORDER BY ts DESC, user_id LIMIT 1000"


def emission_cap(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("day", F.to_date("ts")).where("event_type in ('purchase', 'error')")
    return rollup.capped(rows, turn=["user_id", "day"], order=["ts", "event_id"], succeeded=F.col("event_type") == "purchase", cap=2).select("event_id", "accepted", "cap_hit")


CAP_SQL = "SELECT event_id, event_type = 'purchase' AND n <= 2 AS accepted, n > 2 AS cap_hit FROM (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events WHERE event_type IN ('purchase', 'error'))"


def iso_week(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(rollup.iso_week(F.col("ts")).alias("week_of")).agg(F.count(F.lit(1)).alias("events"))


ISO_WEEK_SQL = "SELECT CAST(date_trunc('week', ts) AS DATE) AS week_of, count(*) AS events FROM events GROUP BY 1"


def weekly_rollup(spark, sf_dir):
    from cairnlake.queries.graph import weekly_rollup as of

    return of(spark, sf_dir)


def _rollup_sql() -> str:
    from cairnlake.queries.model import ANCHORS_SQL, NODES_SQL

    share = lambda a: rounded_sql(f"coalesce({a}::DOUBLE / nullif(total_nodes, 0)::DOUBLE, 0.0::DOUBLE)", 3)
    return f"""WITH {NODES_SQL}, {ANCHORS_SQL}, {_TURNS_SQL}, seen AS (SELECT node_id, max(seen) AS v FROM anchors GROUP BY 1),
n AS (SELECT count(*) AS total_nodes, count(*) FILTER (v >= TIMESTAMP '2001-10-13 00:00:00') AS verified, count(*) FILTER (kind IN ('decision', 'invariant', 'gotcha')) AS knowledge FROM nodes LEFT JOIN seen ON id = node_id),
t AS (SELECT CAST(coalesce(sum(nodes_emitted), 0) AS BIGINT) AS total_emissions, CAST(coalesce(sum(collisions_detected), 0) AS BIGINT) AS total_collisions, count(*) FILTER (cap_hit) AS cap_hits FROM turns WHERE ts >= TIMESTAMP '2024-01-21 00:00:00')
SELECT DATE '2024-01-22' AS week_of, total_nodes, {share("verified")} AS verified_pct_7d, {share("knowledge")} AS knowledge_kind_ratio, total_emissions, total_collisions, cap_hits FROM n, t"""


def _weeks(spark, sf_dir):
    return turns(spark, sf_dir).groupBy(rollup.iso_week(F.col("ts")).alias("week_of")).agg(F.sum("nodes_emitted").alias("total_emissions"), F.count_if("cap_hit").alias("cap_hits"))


def rollup_upsert(spark, sf_dir):
    weeks = _weeks(spark, sf_dir)
    fresh = weeks.where("total_emissions > 0").withColumn("total_emissions", F.col("total_emissions") + 1000).withColumn("week_of", F.date_add("week_of", 7))
    return rollup.upsert_rollup(weeks, fresh)


ROLLUP_UPSERT_SQL = f"WITH {_TURNS_SQL}, w AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week_of, CAST(sum(nodes_emitted) AS BIGINT) AS total_emissions, count(*) FILTER (cap_hit) AS cap_hits FROM turns GROUP BY 1), f AS (SELECT CAST(week_of + 7 AS DATE) AS week_of, total_emissions + 1000 AS total_emissions, cap_hits FROM w WHERE total_emissions > 0) SELECT * FROM f UNION ALL SELECT * FROM w WHERE week_of NOT IN (SELECT week_of FROM f)"

# --- index status and changes ---------------------------------------------------------------


def index_status_diff(spark, sf_dir):
    """Indexed: documents by length; current: the same in German shorter by one, without one source, with another time in French."""
    rows = documents(spark, sf_dir).select("file_path", "lang", "source", F.col("n_chars").alias("size_bytes"), F.col("doc_id").alias("mtime_ms"), F.md5("text").alias("content_hash"))
    old = rows.where("source <> 'src1'")
    new = rows.where("source <> 'src2'").withColumn("size_bytes", F.col("size_bytes") - F.when(F.col("lang") == "de", 1).otherwise(0)).withColumn("mtime_ms", F.when(F.col("lang").isin("fr", "es"), -1).otherwise(F.col("mtime_ms"))).withColumn("content_hash", F.when(F.col("lang") == "en", "other").when(F.col("lang") == "es", "new").otherwise(F.col("content_hash")))
    return staleness.index_status(old, new)


STATUS_SQL = "SELECT count(*) FILTER (source NOT IN ('src1', 'src2') AND lang IN ('de', 'es')) AS stale_files, count(*) FILTER (source = 'src2') AS missing_files, count(*) FILTER (source = 'src1') AS new_files, count(*) FILTER (source IN ('src1', 'src2') OR lang IN ('de', 'es')) = 0 AS fresh FROM documents"


def changed_symbols_interval(spark, sf_dir):
    """Line numbers of items as symbols, the changed range of an order from its key figures."""
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    ranges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", 2).otherwise(4).alias("start_line"), F.when(F.col("o_orderpriority").startswith("1"), 7).otherwise(4).alias("end_line"))
    return intervals.points_in_ranges(points, ranges, key="l_orderkey", point="l_linenumber")


def last_click(spark, sf_dir):
    """Each purchase with the user's last click at or before it."""
    e = table(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    return intervals.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, key="user_id", time="ts", values=["click_id", "click_value"])


LAST_CLICK_SQL = """
WITH c AS (SELECT user_id, ts, max(struct_pack(click_id := event_id, click_value := value)) AS s FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
SELECT e.event_id, e.user_id, e.ts, s.click_id, s.click_value FROM events e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts WHERE e.event_type = 'purchase'"""


INTERVAL_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND l_linenumber BETWEEN CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 4 END AND CASE WHEN starts_with(o_orderpriority, '1') THEN 7 ELSE 4 END)"


def stale_nodes_for_changes(spark, sf_dir):
    """Sources as nodes anchored to their documents; documents in German have changed, the current text is in lower case."""
    docs = documents(spark, sf_dir)
    anchors = docs.select(F.concat_ws("-", "source", "lang").alias("node_id"), F.lit(0).alias("pos"), "file_path", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), text.sha256("text").alias("content_hash"), F.lit(None).cast("string").alias("range_hash"))
    current = docs.select("file_path", F.lower("text").alias("content"))
    found = staleness.stale_nodes_for_files(docs.where("lang = 'de'").select("file_path"), anchors, current)
    return found.select("node_id", F.size("stale_sources").alias("stale"))


STALE_SQL = f"WITH {DOCUMENTS_SQL} SELECT source || '-' || lang AS node_id, CAST(count(*) AS INTEGER) AS stale FROM docs WHERE lang = 'de' AND text <> lower(text) GROUP BY 1"


def _paths(spark, sf_dir):
    """Paths of a repository: parts and suppliers as sources, tests and documents."""
    parts = table(spark, sf_dir, "part").select(F.regexp_replace("p_name", " ", "_").alias("n"), "p_type")
    tests = parts.select(F.concat(F.lit("test/"), F.lower("p_type"), F.lit("/"), "n", F.lit(".test.ts")).alias("file_path"))
    docs = parts.select(F.concat(F.lit("docs/"), "n", F.lit(".md")).alias("file_path"))
    return tests.union(docs).union(spark.createDataFrame([("README.md",), ("ROADMAP.md",), ("src/index.ts",)], "file_path string")).distinct()


_PATHS_SQL = "parts AS (SELECT replace(p_name, ' ', '_') AS n, p_type FROM part), paths AS (SELECT 'test/' || lower(p_type) || '/' || n || '.test.ts' AS file_path FROM parts UNION SELECT 'docs/' || n || '.md' FROM parts UNION SELECT * FROM (VALUES ('README.md'), ('ROADMAP.md'), ('src/index.ts')))"


def likely_tests_stem_join(spark, sf_dir):
    changed = spark.createDataFrame([("src/red_ring.ts",), ("src/lib/Large_Bolt.tsx",)], "file_path string")
    return changes.likely_tests(changed, _paths(spark, sf_dir))


TESTS_SQL = f"WITH {_PATHS_SQL} SELECT file_path, 'name_matches' AS reason FROM paths WHERE regexp_matches(file_path, '(^|/)(test|tests|__tests__)/|\\.(test|spec)\\.[cm]?[jt]sx?$') AND (contains(lower(file_path), 'red_ring') OR contains(lower(file_path), 'large_bolt')) ORDER BY file_path LIMIT 12"


def likely_docs(spark, sf_dir):
    changed = spark.createDataFrame([("src/red_ring.ts",), ("docs/red_ring.md",), ("notes.txt",)], "file_path string")
    return changes.likely_docs(changed, _paths(spark, sf_dir))


DOCS_SQL = f"WITH {_PATHS_SQL} SELECT file_path, 'changed_or_affected' AS reason FROM (VALUES ('docs/red_ring.md'), ('notes.txt')) v(file_path) UNION ALL SELECT file_path, 'top_level' FROM paths WHERE file_path IN ('README.md', 'CONTRIBUTING.md', 'CHANGELOG.md', 'ROADMAP.md')"


def change_risk(spark, sf_dir):
    """Customers as diffs: orders are changed files, by status stale or deleted."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("changed"), F.count_if(F.col("o_orderstatus") == "P").alias("deleted"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("stale"), F.count_if(F.col("o_totalprice") > 400000).alias("affected"))
    return rows.select("o_custkey", changes.risk(F.col("changed"), F.col("stale"), F.col("affected"), F.col("deleted")).alias("risk"))


RISK_SQL = "SELECT o_custkey, CASE WHEN d > 1 OR d > 0 AND (s > 0 OR a > 0 OR c > 3) OR s > 2 OR a > 8 OR c > 10 THEN 'high' WHEN d > 0 OR s > 0 OR a > 0 OR c > 3 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT o_custkey, count(*) AS c, count(*) FILTER (o_orderstatus = 'P') AS d, count(*) FILTER (starts_with(o_orderpriority, '1')) AS s, count(*) FILTER (o_totalprice > 400000) AS a FROM orders GROUP BY o_custkey)"

# --- dependencies --------------------------------------------------------------------------------


def _module_files(spark, sf_dir):
    """Orders import the parts of their items; every part is a file, and so is every order."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    imports = F.transform("x", lambda i: F.struct(F.concat(F.lit("../parts/"), i["l_partkey"].cast("string"), F.lit(".js")).alias("module"), i["l_linenumber"].alias("line")))
    orders = items.select(F.concat(F.lit("src/orders/"), F.col("l_orderkey").cast("string"), F.lit(".ts")).alias("file_path"), imports.alias("imports"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("src/parts/"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 25, ".ts").otherwise("/index.ts")).alias("file_path"), F.array().cast("array<struct<module:string,line:int>>").alias("imports"))
    return orders.unionByName(parts)


_IMPORTS_SQL = "imp AS (SELECT 'src/orders/' || l_orderkey || '.ts' AS from_path, '../parts/' || l_partkey || '.js' AS module, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS ord, 'src/parts/' || l_partkey || CASE WHEN p_size > 25 THEN '.ts' ELSE '/index.ts' END AS to_path FROM lineitem JOIN part ON p_partkey = l_partkey)"


def import_edges(spark, sf_dir):
    return deps.import_edges(_module_files(spark, sf_dir)).select("from_path", "module", "line", "to_path")


IMPORT_SQL = f"WITH {_IMPORTS_SQL} SELECT from_path, module, line, to_path FROM imp"


def reverse_imports(spark, sf_dir):
    found = deps.reverse_imports(deps.import_edges(_module_files(spark, sf_dir)))
    return found.select("file_path", F.size("importers").alias("n"), F.sha2(F.array_join(F.transform("importers", lambda i: F.concat_ws(":", i["importer"], i["line"].cast("string"))), ","), 256).alias("importers"))


REVERSE_SQL = f"WITH {_IMPORTS_SQL} SELECT to_path AS file_path, CAST(count(*) AS INTEGER) AS n, sha256(string_agg(from_path || ':' || line, ',' ORDER BY from_path, ord)) AS importers FROM imp GROUP BY to_path"


def dependency_context(spark, sf_dir):
    files = _module_files(spark, sf_dir)
    return deps.dependency_context(deps.import_edges(files), files.select("file_path"), 3).select("target", "direction", "file_path", "import_line", "rank")


DEPENDENCY_SQL = f"""
WITH {_IMPORTS_SQL}, e AS (
  SELECT from_path AS target, 'imports' AS direction, to_path AS file_path, line AS import_line, 0 AS d, '' AS p, ord FROM imp
  UNION ALL SELECT to_path, 'imported_by', from_path, line, 1, from_path, ord FROM imp WHERE from_path <> to_path
), once AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY target, direction, file_path ORDER BY d, p, ord) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY d, p, ord) AS rank FROM once)
SELECT target, direction, file_path, import_line, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""


def link_extraction(spark, sf_dir):
    """Local links of pages, resolved against the url's folder."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("href"))
    return pages.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


LINK_SQL = "SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS href FROM pages) GROUP BY ALL"


def target_symbol_score(spark, sf_dir):
    from cairnlake.functions.scoring import symbol_score

    return table(spark, sf_dir, "part").select("p_partkey", symbol_score(F.regexp_replace("p_name", " ", ""), "find RedRing in ring_list").alias("score"))


SYMBOL_SQL = "SELECT p_partkey, CASE WHEN s = 'find redring in ring_list' THEN 100.0::DOUBLE WHEN contains('find redring in ring_list', s) THEN 90.0::DOUBLE WHEN contains(s, 'find redring in ring_list') THEN 80.0::DOUBLE ELSE " + " + ".join(["0.0::DOUBLE", *[f"CASE WHEN s = '{t}' THEN 50.0::DOUBLE WHEN contains(s, '{t}') THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END" for t in ("find", "red", "ring", "in", "ring_list")]]) + " END AS score FROM (SELECT p_partkey, lower(replace(p_name, ' ', '')) AS s FROM part)"


def symbol_definitions(spark, sf_dir):
    """Names of parts as symbols, sizes as lines; each kind of part is a file cut into chunks of ten lines."""
    p = table(spark, sf_dir, "part").select(F.lower("p_type").alias("file_path"), F.col("p_name").alias("name"), F.lit("const").alias("kind"), F.col("p_size").alias("line")).distinct()
    files = p.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("name", "kind", "line"))).alias("symbols"))
    chunk = files.select("file_path", F.explode(F.sequence(F.lit(1), F.lit(50), F.lit(10))).alias("start_line")).withColumn("end_line", F.col("start_line") + 9).withColumn("content", F.concat_ws(":", "file_path", F.col("start_line").cast("string")))
    return deps.symbol_definitions(files, chunk, "red ring", 8).select("file_path", "line", "start_line", "content")


DEFINITIONS_SQL = "SELECT file_path, line, CAST((line - 1) // 10 * 10 + 1 AS INTEGER) AS start_line, file_path || ':' || ((line - 1) // 10 * 10 + 1) AS content FROM (SELECT DISTINCT lower(p_type) AS file_path, p_size AS line FROM part WHERE p_name = 'red ring') ORDER BY file_path, line LIMIT 8"

# --- writeback and predicates ----------------------------------------------------------------------


def writeback_rules(spark, sf_dir):
    """Turns of conversations as work summaries; files and related nodes by the role and place of the turn."""
    rows = table(spark, sf_dir, "conversations").withColumn("t", F.concat_ws(" ", F.lower("text"), F.when(F.col("role") == "user", "please review the design")))
    n = lambda cond: F.when(cond, 1).otherwise(0)
    s = writeback.suggestions(F.col("t"), F.lit(1), n(F.col("turn") > 1), n(F.col("role") == "user"), F.lit(False), F.col("role") == "user", F.lit(False), F.col("turn"), n(F.col("turn") == 0), 3)
    return rows.select("conv_id", "turn", F.array_join(F.transform(s, lambda x: F.concat_ws("=", x["kind"], F.format_string("%.2f", x["confidence"]))), ",").alias("suggestions"))


_words = lambda p: f"regexp_matches(t, '{p}')"
WRITEBACK_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, concat_ws(' ', lower(text), CASE WHEN role = 'user' THEN 'please review the design' END) AS t FROM conversations),
s AS (SELECT *, [x for x in [
 CASE WHEN {_words(predicates.GOTCHA_WORDS)} OR turn = 0 THEN 'gotcha=' || CASE WHEN turn = 0 THEN '0.76' ELSE '0.68' END END,
 CASE WHEN {_words(predicates.DECISION_WORDS)} THEN 'decision=' || CASE WHEN turn > 1 THEN '0.74' ELSE '0.58' END END,
 CASE WHEN {_words(predicates.INVARIANT_WORDS)} OR role = 'user' THEN 'invariant=' || CASE WHEN role = 'user' THEN '0.72' ELSE '0.64' END END,
 CASE WHEN turn >= 2 THEN 'link=0.62' END] if x IS NOT NULL] AS l FROM c)
SELECT conv_id, turn, array_to_string(l[1:3], ',') AS suggestions FROM s"""


def validate_timestamps(spark, sf_dir):
    shapes = F.array(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'"), F.date_format("ts", "yyyy-MM-dd"), F.concat(F.date_format("ts", "yyyy-MM"), F.lit("-45T00:00:00Z")))
    rows = _events(spark, sf_dir).select("event_id", F.posexplode(shapes).alias("shape", "text"))
    return rows.select("event_id", "shape", predicates.is_valid_timestamp("text", F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("valid"))


TIMESTAMP_SQL = "SELECT event_id, CAST(shape AS INTEGER) AS shape, CASE shape WHEN 0 THEN date_trunc('second', ts) <= TIMESTAMP '2024-01-20 00:05:00' WHEN 1 THEN date_trunc('minute', ts) <= TIMESTAMP '2024-01-20 00:05:00' ELSE false END AS valid FROM events, (VALUES (0), (1), (2), (3)) v(shape)"


def safe_paths(spark, sf_dir):
    """Paths of page urls, some led by a slash, some with a step upwards."""
    path = F.regexp_extract("url", "://[^/?#]*/?([^?#]*)", 1)
    made = F.when(F.col("url").startswith("https"), path).when(F.col("url").contains("/en/"), F.concat(F.lit("/"), path)).otherwise(F.concat(path, F.lit("/../x")))
    return table(spark, sf_dir, "pages").select("page_id", predicates.is_safe_path(made).alias("safe"))


SAFE_SQL = "SELECT page_id, CASE WHEN starts_with(url, 'https') THEN regexp_matches(p, '[^ ]') ELSE false END AS safe FROM (SELECT page_id, url, regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1) AS p FROM pages)"


def asks_for_code(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", predicates.asks_for_code_col("text").alias("impact"))


ASKS_SQL = "SELECT conv_id, turn, len([w for w in string_split_regex(text, '[ \\t\\n\\v\\f\\r]+') if " + " OR ".join(f"regexp_matches(w, '{s}')" for s in predicates.CODE_SHAPES) + "]) > 0 AS impact FROM conversations"

REGISTRY = {
    "turn_counters": (turn_counters, TURN_SQL),
    "newest_turns": (newest_turns, NEWEST_SQL),
    "emission_cap": (emission_cap, CAP_SQL),
    "iso_week": (iso_week, ISO_WEEK_SQL),
    "weekly_rollup": (weekly_rollup, _rollup_sql()),
    "rollup_upsert": (rollup_upsert, ROLLUP_UPSERT_SQL),
    "index_status_diff": (index_status_diff, STATUS_SQL),
    "changed_symbols_interval": (changed_symbols_interval, INTERVAL_SQL),
    "last_click": (last_click, LAST_CLICK_SQL),
    "stale_nodes_for_changes": (stale_nodes_for_changes, STALE_SQL),
    "likely_tests_stem_join": (likely_tests_stem_join, TESTS_SQL),
    "likely_docs": (likely_docs, DOCS_SQL),
    "change_risk": (change_risk, RISK_SQL),
    "import_edges": (import_edges, IMPORT_SQL),
    "reverse_imports": (reverse_imports, REVERSE_SQL),
    "dependency_context": (dependency_context, DEPENDENCY_SQL),
    "link_extraction": (link_extraction, LINK_SQL),
    "target_symbol_score": (target_symbol_score, SYMBOL_SQL),
    "symbol_definitions": (symbol_definitions, DEFINITIONS_SQL),
    "writeback_rules": (writeback_rules, WRITEBACK_SQL),
    "validate_timestamps": (validate_timestamps, TIMESTAMP_SQL),
    "safe_paths": (safe_paths, SAFE_SQL),
    "asks_for_code": (asks_for_code, ASKS_SQL),
}
