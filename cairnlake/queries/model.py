"""The driver's tables read as the engine's model, in Spark and as SQL for DuckDB.

Parts are graph nodes, line items their source anchors, documents are chunks of
files, events are the activity log. Each reading has the same columns on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.schemas import NODE_KINDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Largest p_size of each kind but the last.
KIND_SIZES = dict(zip(NODE_KINDS, (5, 10, 15, 20, 25, 30, 35, 40)))
NOW = "2001-12-01 00:00:00"

NODES_SQL = (
    "nodes AS (SELECT 'part/' || p_partkey AS id, CASE "
    + " ".join(f"WHEN p_size <= {n} THEN '{k}'" for k, n in KIND_SIZES.items())
    + " ELSE 'gotcha' END AS kind, p_name AS name, p_type || ' made by ' || p_brand AS summary, [p_brand, p_type] AS tags, [p_name || ' ' || lower(p_type)] AS aliases,"
    " CASE WHEN p_size > 45 THEN 'deprecated' ELSE 'active' END AS status, (p_retailprice - 900) / 100 AS confidence, CAST(p_partkey AS INTEGER) AS map_pos FROM part)"
)
ANCHORS_SQL = "anchors AS (SELECT 'part/' || l_partkey AS node_id, 'orders/' || l_orderkey AS file_path, l_linenumber AS start_line, CAST(l_linenumber + l_quantity AS INTEGER) AS end_line, l_shipdate AS seen FROM lineitem)"
TOKENS_SQL = "[t for t in string_split_regex(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9_$]+') if length(t) > 1]"


def rounded_sql(x: str, places: int = 4) -> str:
    by = f"{10**places}.0::DOUBLE"
    return f"(floor(({x}) * {by} + 0.5::DOUBLE) / {by})"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = None
    for k, n in KIND_SIZES.items():
        kind = F.when(F.col("p_size") <= n, k) if kind is None else kind.when(F.col("p_size") <= n, k)
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("id"),
        kind.otherwise("gotcha").alias("kind"),
        F.col("p_name").alias("name"),
        F.concat("p_type", F.lit(" made by "), "p_brand").alias("summary"),
        F.array("p_brand", "p_type").alias("tags"),
        F.array(F.concat_ws(" ", "p_name", F.lower("p_type"))).alias("aliases"),
        F.when(F.col("p_size") > 45, "deprecated").otherwise("active").alias("status"),
        ((F.col("p_retailprice") - 900) / 100).alias("confidence"),
        F.col("p_partkey").cast("int").alias("map_pos"),
    )


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("node_id"),
        F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string")).alias("file_path"),
        F.col("l_linenumber").alias("start_line"),
        (F.col("l_linenumber") + F.col("l_quantity")).cast("int").alias("end_line"),
        F.col("l_shipdate").cast("timestamp").alias("seen"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the path source/doc_id."""
    return table(spark, sf_dir, "documents").withColumn("file_path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))


DOCUMENTS_SQL = "docs AS (SELECT *, source || '/' || doc_id AS file_path FROM documents)"

CHUNKS_SQL = (
    "chunks AS (SELECT d.doc_id, d.source, d.source || '/' || d.doc_id AS file_path, 'file' AS chunk_type, d.lang AS symbol, d.source AS module, d.lang AS export, d.text AS content,"
    " CASE WHEN l.doc_id IS NOT NULL THEN 'quality ' || l.quality || ' toxic ' || l.toxic END AS related FROM documents d LEFT JOIN labels l USING (doc_id))"
)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: the language as symbol and export, the source as import."""
    return documents(spark, sf_dir).select(
        "doc_id", "source", "file_path", F.lit("file").alias("chunk_type"),
        F.array(F.struct(F.col("lang").alias("name"), F.lit("const").alias("kind"), F.lit(1).alias("line"), F.lit(True).alias("exported"))).alias("symbols"),
        F.array(F.struct(F.col("source").alias("module"), F.lit(1).alias("line"))).alias("imports"),
        F.array("lang").alias("exports"), F.col("text").alias("content"),
    )


def related_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, related): the labels of documents as nodes related to their files."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("q"), F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("t"))
    rows = documents(spark, sf_dir).select("doc_id", "file_path").join(labels, "doc_id")
    node = F.struct(F.concat(F.lit("label/"), F.col("doc_id").cast("string")).alias("id"), F.lit("concept").alias("kind"), F.col("q").alias("name"), F.col("t").alias("summary"))
    return rows.select("file_path", F.array(node).alias("related"))


def turn_names() -> dict[str, str]:
    """Counter of a turn -> kind of event."""
    return {"queries": "view", "results_returned": "click", "nodes_emitted": "purchase", "collisions_detected": "error"}
