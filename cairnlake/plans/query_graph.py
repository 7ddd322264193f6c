"""Graph query: lexical candidates, staleness of these alone, quality re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import quality
from cairnlake.operators import graph, staleness


def over_fetch(limit: int) -> int:
    """Candidates that enter the re-ranking."""
    return min(50, max(3 * limit, limit + 10))


def query_graph(nodes: DataFrame, question: str, now: Column, *, limit: int = 10, current: DataFrame | None = None) -> DataFrame:
    """The best nodes by ranking, lexical score, quality and id.

    ``current`` (file_path, content) is what the sources look like now; without
    it sources stay unchecked.
    """
    limit = min(50, max(1, limit))
    rows = graph.lexical_query(nodes, question, over_fetch(limit))
    rows = rows.withColumn("n_sources", F.size("sources"))
    if current is None:
        rows = rows.withColumn("stale", F.lit(0).cast("long"))
    else:
        counts = staleness.stale_counts(staleness.classify(graph.anchors(rows), current)).select("node_id", "stale")
        rows = rows.join(counts, F.col("id") == F.col("node_id"), "left").drop("node_id").fillna(0, ["stale"])
    rows = rows.withColumn("freshness", quality.freshness(F.lit(current is not None), F.col("n_sources"), F.col("stale"))).withColumn("age_days", quality.age_days(F.col("last_verified_at"), now))
    rows = rows.withColumn("quality", quality.score(F.col("confidence"), quality.freshness_factor(F.col("freshness"), F.col("n_sources"), F.col("stale")), F.col("age_days"), F.col("kind"), F.col("status")))
    rows = rows.withColumn("trust", quality.trust(F.col("status"), F.col("freshness"), F.col("confidence"), F.col("quality")))
    rows = rows.withColumn("reasons", quality.reasons(F.col("confidence"), F.col("freshness"), F.col("stale"), F.col("n_sources"), F.col("age_days"), F.col("kind"), F.col("status"), F.col("trust")))
    rows = rows.withColumn("ranking_score", quality.ranking(F.col("score"), F.col("quality")))
    return rows.orderBy(F.desc("ranking_score"), F.desc("score"), F.desc("quality"), "id").limit(limit)
