"""Mixing sources to target weights, in DataFrame functions only.

Tokens (words) are added up per source. Sources in code point order, null last,
weigh 5, 2, 1 and again 5, 2, 1 ...; each gets its weight's share of all words,
but never more than ``cap`` times its own words: what lies above is shared out
anew by weight until no source is above. The fixed point of that is one water
level: target = least(cap * size, weight * level), where the level is the
largest value of (total - words of capped sources) / (weight of the others) as
sources are capped in the order of size / weight. One window over the sources
(not the documents) finds it.

A source's rate is target / size. Each document is taken floor(rate) times and
once more if a hash of seed and id, read as a number in [0, 1), lies below the
fraction of the rate; so runs agree and nothing is gathered.

A null text has size 0; a null source is a source of its own, a source without
words has target 0 and rate 0. Rows with the same id, or with null ids, share
their draw. An empty table gives an empty result. Long texts are counted whole.

The sources are one narrow row each. Their targets are worked out in one task,
which holds for up to ``MOST_SOURCES``; more is an error. They are broadcast to
the documents up to ``BROADCAST_SOURCES``, by a count, and joined beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairnlake.llm.common import WORD, persist, pick, release

WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix-1"
MOST_SOURCES, BROADCAST_SOURCES = 5_000_000, 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed:id)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target from (source, source_size), one row a source."""
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("w", F.get(table, F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))).cast("int")))
    weighed = weighed.withColumn("most", F.col("source_size") * cap)
    by_ratio = W.orderBy((F.col("most").cast("double") / F.col("w")), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(by_ratio), F.lit(0))
    weight = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0))
    level = weighed.withColumn("level", left.cast("double") / weight).withColumn("level", F.max("level").over(whole))
    return level.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("w") * F.col("level")).alias("target"))


def copies(target: Column, source_size: Column, id_col: Column, seed: str = SEED) -> Column:
    """floor(rate), and one more with the probability of rate's fraction."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    return (F.floor(rate) + F.when(draw(id_col, seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def goals(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """``targets``, written out, as a broadcast where their count allows it."""
    sizes = persist(sizes)
    n = sizes.count()
    if n > MOST_SOURCES:
        raise ValueError(f"{n} sources are more than {MOST_SOURCES}: group them first")
    goal = persist(targets(sizes, weights=weights, cap=cap))
    release(sizes)
    return F.broadcast(goal) if n <= BROADCAST_SOURCES else goal


def mixture_plan(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``id_col``, size, source_size, target, copies, taken for every row."""
    rows = pick(documents, id=id_col, source=source_col, text=text_col)
    rows = persist(rows.select("id", "source", n_words(F.col("text")).alias("size")))
    goal = goals(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap).withColumnRenamed("source", "s")
    out = rows.join(goal, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies(F.col("target"), F.col("source_size"), F.col("id"), seed))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``documents`` as often as it is taken, numbered in ``copy``.

    If ``documents`` has a column of that name, the number's column gets as many
    underscores as make its name new.
    """
    number = "copy"
    while number in documents.columns:
        number += "_"
    sizes = documents.groupBy(documents[source_col].alias("source")).agg(F.sum(n_words(documents[text_col])).alias("source_size"))
    goal = goals(sizes, weights, cap).select(F.struct("source", "source_size", "target").alias("__goal"))
    joined = documents.join(goal, documents[source_col].eqNullSafe(F.col("__goal.source")))
    taken = joined.withColumn("__n", copies(F.col("__goal.target"), F.col("__goal.source_size"), documents[id_col], seed)).where("__n > 0")
    return taken.select(*[documents[c] for c in documents.columns], F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias(number))
