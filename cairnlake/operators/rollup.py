"""Activity log: turns, caps and the weekly rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairnlake.functions.text import rounded
from cairnlake.schemas import KNOWLEDGE_KINDS

MAX_TURNS, TURN_CAP, WEEK_DAYS = 1000, 5, 7


def iso_week(ts: Column) -> Column:
    """The Monday of the week, in the session's time zone (UTC)."""
    return F.to_date(F.date_trunc("week", ts))


def share(part: Column, whole: Column) -> Column:
    return rounded(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), 3)


def turn_counters(events: DataFrame, *, user: str, ts: str, kind: str, opens: str, names: dict[str, str]) -> DataFrame:
    """Counts of each kind of event (name -> kind) for every turn; a turn opens with an ``opens`` event, what comes before one is no turn's."""
    number = F.count_if(F.col(kind) == opens).over(W.partitionBy(user).orderBy(ts, "event_id").rowsBetween(W.unboundedPreceding, 0))
    rows = events.withColumn("turn", number).where("turn > 0")
    return rows.groupBy(user, "turn").agg(F.min(ts).alias("started"), *[F.count_if(F.col(kind) == k).alias(n) for n, k in names.items()])


def newest_turns(turns: DataFrame, *, order: list[Column], most: int = MAX_TURNS) -> DataFrame:
    """The bounded log: the newest turns first."""
    return turns.orderBy(*order).limit(most)


def capped(attempts: DataFrame, *, turn: list[str], order: list[str], succeeded: Column, cap: int = TURN_CAP) -> DataFrame:
    """``attempts`` with ``accepted``: only successes count towards the cap of a turn, and none passes beyond it."""
    n = F.sum(F.when(succeeded, 1).otherwise(0)).over(W.partitionBy(*turn).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return attempts.withColumn("accepted", succeeded & (n <= cap)).withColumn("cap_hit", n > cap)


def node_stats(nodes: DataFrame, now: Column) -> DataFrame:
    """One row over all nodes, deprecated ones too: total, verified within seven days, of a knowledge kind."""
    since = now - F.expr(f"INTERVAL {WEEK_DAYS} DAYS")
    return nodes.agg(F.count(F.lit(1)).alias("total_nodes"), F.count_if(F.col("last_verified_at") >= since).alias("verified"), F.count_if(F.col("kind").isin(*KNOWLEDGE_KINDS)).alias("knowledge"))


def turn_stats(turns: DataFrame, now: Column) -> DataFrame:
    """One row over the turns of the last seven days."""
    recent = turns.where(F.col("ts") >= now - F.expr(f"INTERVAL {WEEK_DAYS} DAYS"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return recent.agg(total("nodes_emitted").alias("total_emissions"), total("collisions_detected").alias("total_collisions"), F.count_if("cap_hit").alias("cap_hits"))


def weekly_rollup(nodes: DataFrame, turns: DataFrame, now: Column) -> DataFrame:
    """The rollup row of the week of ``now``."""
    both = node_stats(nodes, now).join(F.broadcast(turn_stats(turns, now)), how="cross")
    return both.select(iso_week(now).alias("week_of"), "total_nodes", share(F.col("verified"), F.col("total_nodes")).alias("verified_pct_7d"), share(F.col("knowledge"), F.col("total_nodes")).alias("knowledge_kind_ratio"), "total_emissions", "total_collisions", "cap_hits")


def upsert_rollup(rollups: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replaces the rows of the fresh weeks, or adds them; newest week first."""
    return fresh.select(*rollups.columns).unionByName(rollups.join(fresh.select("week_of"), "week_of", "left_anti")).orderBy(F.desc("week_of"))
