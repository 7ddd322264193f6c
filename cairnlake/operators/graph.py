"""Operators on the property graph: lookups, lexical query, merges and overrides.

Nodes are rows of ``schemas.NODES``, edges rows of ``schemas.EDGES``. Every
operator returns a new DataFrame; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairnlake.functions import scoring
from cairnlake.functions.text import graph_tokens


def get_node(nodes: DataFrame, key: str) -> DataFrame:
    """The node with this id, else the first (in document order) with this alias; no row or one."""
    found = nodes.where((F.col("id") == key) | F.array_contains("aliases", key))
    return found.orderBy((F.col("id") == key).desc(), "map_pos").limit(1)


def list_nodes(nodes: DataFrame, *, include_deprecated: bool = False) -> DataFrame:
    return (nodes if include_deprecated else nodes.where("status != 'deprecated'")).orderBy("id")


def resolve_ids(keys: DataFrame, nodes: DataFrame, *, key_col: str = "key") -> DataFrame:
    """(key, id): each key's node by id or else by alias; keys without one are left out."""
    by_id = nodes.select(F.col("id").alias("k"), F.lit(0).alias("rank"), "map_pos", "id")
    by_alias = nodes.select(F.explode("aliases").alias("k"), F.lit(1).alias("rank"), "map_pos", "id")
    named = by_id.unionByName(by_alias).groupBy("k").agg(F.min_by("id", F.struct("rank", "map_pos")).alias("id"))
    return keys.select(F.col(key_col).alias("key")).distinct().join(named, F.col("key") == F.col("k")).select("key", "id")


def incident_edges(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where((F.col("from") == node_id) | (F.col("to") == node_id))


def summaries(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "kind", "name", "summary")


def knowledge_nodes(nodes: DataFrame, kinds: tuple[str, ...], limit: int = 12) -> DataFrame:
    return list_nodes(nodes).where(F.col("kind").isin(*kinds)).limit(limit)


def scored_nodes(nodes: DataFrame, question: str, **columns: str) -> DataFrame:
    """Active nodes with a positive lexical score, its breakdown and reasons."""
    tokens = graph_tokens(question)
    scored = nodes.where("status != 'deprecated'").withColumn("score_breakdown", scoring.node_breakdown(tokens, **columns))
    scored = scored.withColumn("score", scoring.node_score(F.col("score_breakdown"))).where("score > 0")
    return scored.withColumn("match_reasons", scoring.node_reasons(tokens, **columns))


def lexical_query(nodes: DataFrame, question: str, limit: int = 10) -> DataFrame:
    """The best nodes: score descending, id ascending."""
    return scored_nodes(nodes, question).orderBy(F.desc("score"), "id").limit(limit)


def induced_edges(edges: DataFrame, ids: DataFrame, *, id_col: str = "id") -> DataFrame:
    """Edges with both ends among ``ids``."""
    chosen = ids.select(F.col(id_col).alias("__id")).distinct()
    return edges.join(chosen, edges["from"] == chosen["__id"], "left_semi").join(chosen, edges["to"] == chosen["__id"], "left_semi")


def anchors(nodes: DataFrame) -> DataFrame:
    """One row for each source of a node, with its place."""
    return nodes.select(F.col("id").alias("node_id"), F.posexplode("sources").alias("pos", "s")).select("node_id", "pos", "s.*")


# --- writes ------------------------------------------------------------------------


def _with_topic(tags: Column, topic: str | None) -> Column:
    return tags if topic is None else F.when(F.array_contains(tags, topic), tags).otherwise(F.concat(tags, F.array(F.lit(topic))))


def merge_once(nodes: DataFrame, incoming: DataFrame, active_topic: str | None = None) -> DataFrame:
    """Upsert of at most one incoming row for each target id (``target``, else ``id``).

    An existing node keeps kind and name; its summary and confidence are
    replaced if the incoming confidence is at least as high; sources, status and
    verification are refreshed; tags and aliases are united, the topic comes last.
    """
    target = F.coalesce("target", "id") if "target" in incoming.columns else F.col("id")
    new = incoming.select(target.alias("id"), F.struct("kind", "name", "summary", "sources", "tags", "aliases", "status", "confidence", "last_verified_at").alias("n"))
    old = nodes.select("id", F.struct("kind", "name", "summary", "sources", "tags", "aliases", "status", "confidence", "last_verified_at").alias("o"), "map_pos")
    both = old.join(new, "id", "full_outer")
    o, n = F.col("o"), F.col("n")
    replaced = n["confidence"] >= o["confidence"]

    def pick(field: str, merged: Column, inserted: Column | None = None) -> Column:
        return F.when(n.isNull(), o[field]).when(o.isNull(), n[field] if inserted is None else inserted).otherwise(merged).alias(field)

    return both.select(
        "id",
        pick("kind", o["kind"]),
        pick("name", o["name"]),
        pick("summary", F.when(replaced, n["summary"]).otherwise(o["summary"])),
        pick("sources", n["sources"]),
        pick("tags", _with_topic(F.array_union(o["tags"], n["tags"]), active_topic), _with_topic(n["tags"], active_topic)),
        pick("aliases", F.array_union(o["aliases"], n["aliases"])),
        pick("status", n["status"]),
        pick("confidence", F.when(replaced, n["confidence"]).otherwise(o["confidence"])),
        pick("last_verified_at", n["last_verified_at"]),
        "map_pos",
    )


def upsert_nodes(nodes: DataFrame, incoming: DataFrame, *, active_topic: str | None = None, order_col: str | None = None) -> DataFrame:
    """Upsert of a batch; rows for one target are folded in by ``order_col``, as if they came one by one."""
    return merge_once(nodes, incoming, active_topic) if order_col is None else fold_in(nodes, incoming, order_col, active_topic)


def fold_in(nodes: DataFrame, incoming: DataFrame, order_col: str, active_topic: str | None = None) -> DataFrame:
    """``merge_once`` of any number of rows for each target, in one aggregation.

    Each field of the outcome is an aggregate that combines in any grouping: the
    confidence is the largest, the summary is that of its last row, what is refreshed
    is the last row's, and tags and aliases come in the order of their first row and
    place. So rows are combined before the shuffle, and no task holds all rows of one
    target. A confidence that is null never yields, and a null one replaces nothing.
    Rows of one target and order count in the order of a hash of them; null arrays
    are empty.
    """
    target = F.coalesce("target", "id") if "target" in incoming.columns else F.col("id")
    fields = ["kind", "name", "summary", "sources", "tags", "aliases", "status", "confidence", "last_verified_at"]
    none = F.array().cast("array<string>")
    rows = incoming.withColumns({c: F.coalesce(c, none) for c in ("tags", "aliases")})
    rows = rows.select(target.alias("id"), F.struct(F.col(order_col).alias("o"), F.xxhash64(*fields).alias("h")).alias("at"), *fields)
    best = F.max(F.when(F.col("confidence").isNotNull(), F.struct("confidence", "at", "summary")))
    scalars = rows.groupBy("id").agg(
        F.min_by(F.struct("kind", "name", "summary", "tags", "aliases", "confidence"), "at").alias("first"),
        F.max_by(F.struct("sources", "status", "last_verified_at"), "at").alias("last"),
        best.alias("best"),
        (F.count(F.lit(1)) > 1).alias("several"),
    )
    placed = lambda name: F.transform(name, lambda x, i: F.struct(F.lit(name).alias("list"), x.alias("x"), i.alias("i")))
    elements = rows.select("id", "at", F.explode(F.concat(placed("tags"), placed("aliases"))).alias("e")).groupBy("id", "e.list", "e.x").agg(F.min(F.struct("at", "e.i")).alias("at"))
    lists = elements.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "list", "x"))).alias("all"))
    of = lambda name: F.coalesce(F.transform(F.filter("all", lambda e: e["list"] == name), lambda e: e["x"]), none)
    new = scalars.join(lists, "id", "left").select("id", "first", "last", "best", "several", of("tags").alias("tags"), of("aliases").alias("aliases"))
    old = nodes.select("id", F.struct(*fields).alias("old"), "map_pos")
    both = old.join(new.select("id", F.struct("first", "last", "best", "several", "tags", "aliases").alias("new")), "id", "full_outer")
    o, n = F.col("old"), F.col("new")
    there, base = o.isNotNull(), lambda field: F.when(o.isNotNull(), o[field]).otherwise(n["first"][field])
    better = base("confidence").isNotNull() & n["best"].isNotNull() & (n["best"]["confidence"] >= base("confidence"))
    start = _with_topic(F.when(there, F.array_union(o["tags"], n["first"]["tags"])).otherwise(n["first"]["tags"]), active_topic)
    united = F.when(there | n["several"], F.array_union(start, n["tags"])).otherwise(start)
    also = F.when(there, F.array_union(o["aliases"], n["aliases"])).when(n["several"], F.array_union(n["first"]["aliases"], n["aliases"])).otherwise(n["first"]["aliases"])
    kept = lambda field, merged: F.when(n.isNull(), o[field]).otherwise(merged).alias(field)
    return both.select(
        "id",
        base("kind").alias("kind"),
        base("name").alias("name"),
        kept("summary", F.when(better, n["best"]["summary"]).otherwise(base("summary"))),
        kept("sources", n["last"]["sources"]),
        kept("tags", united),
        kept("aliases", also),
        kept("status", n["last"]["status"]),
        kept("confidence", F.when(better, n["best"]["confidence"]).otherwise(base("confidence"))),
        kept("last_verified_at", n["last"]["last_verified_at"]),
        "map_pos",
    )


def ensure_edges(edges: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert, or replace the note where a note is given; identity is (from, to, kind)."""
    new = incoming.groupBy("from", "to", "kind").agg(F.last("note", ignorenulls=True).alias("new_note"))
    return edges.join(new, ["from", "to", "kind"], "full_outer").select("from", "to", "kind", F.coalesce("new_note", "note").alias("note"))


def ensure_topics(topics: DataFrame, names: DataFrame, now: Column, *, auto_created: bool = True) -> DataFrame:
    """Topics and those of ``names`` (column name) that are missing."""
    fresh = names.select("name").distinct().join(topics, "name", "left_anti")
    return topics.select("name", "created_at", "auto_created").unionByName(fresh.select("name", now.alias("created_at"), F.lit(auto_created).alias("auto_created")))


def override(nodes: DataFrame, node_id: str, patch: dict[str, Column], now: Column) -> DataFrame:
    """Replaces fields of one node; the verification is ``now`` unless patched."""
    patch = {"last_verified_at": now} | patch
    return nodes.withColumns({c: F.when(F.col("id") == node_id, v).otherwise(F.col(c)) for c, v in patch.items()})


def changed_set(values: Column, add: list[str], remove: list[str]) -> Column:
    """Additions first, then removals; order of first appearance."""
    plain = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return F.array_except(F.array_union(values, plain(add)), plain(remove))


def correct(nodes: DataFrame, key: str, now: Column, *, name: str | None = None, summary: str | None = None, kind: str | None = None, confidence: float | None = None, add_tags=(), remove_tags=(), add_aliases=(), remove_aliases=()) -> DataFrame:
    """Overrides by flags, the key being an id or alias; without flags nothing changes."""
    if confidence is not None and not 0 <= confidence <= 1:
        raise ValueError("confidence must lie between 0 and 1")
    patch = {c: F.lit(v) for c, v in (("name", name), ("summary", summary), ("kind", kind), ("confidence", confidence)) if v is not None}
    if add_tags or remove_tags:
        patch["tags"] = changed_set(F.col("tags"), list(add_tags), list(remove_tags))
    if add_aliases or remove_aliases:
        patch["aliases"] = changed_set(F.col("aliases"), list(add_aliases), list(remove_aliases))
    found = get_node(nodes, key).select("id").first()
    if found is None:
        raise KeyError(key)
    return override(nodes, found.id, patch, now) if patch else nodes


def deprecated_summary(summary: Column, reason: str | None) -> Column:
    return F.concat(F.lit(f"[deprecated: {reason}] "), summary) if reason else summary


def deprecate(nodes: DataFrame, key: str, now: Column, reason: str | None = None) -> DataFrame:
    """Marks a node as deprecated; the reason goes in front of the summary."""
    found = get_node(nodes, key).select("id").first()
    if found is None:
        raise KeyError(key)
    return override(nodes, found.id, {"status": F.lit("deprecated"), "summary": deprecated_summary(F.col("summary"), reason)}, now)


def link(nodes: DataFrame, edges: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with the requested ones, requests with an unknown end); ends are ids or aliases."""
    keys = requests.select(F.explode(F.array("from", "to")).alias("key"))
    ids = resolve_ids(keys, nodes)
    ends = requests.join(ids.select(F.col("key").alias("from"), F.col("id").alias("f")), "from", "left").join(ids.select(F.col("key").alias("to"), F.col("id").alias("t")), "to", "left")
    known = ends.where("f is not null and t is not null").select(F.col("f").alias("from"), F.col("t").alias("to"), "kind", "note")
    return ensure_edges(edges, known), ends.where("f is null or t is null").select("from", "to", "kind", "note")
