"""Points in ranges by aligned blocks, and the last state before a moment, without a range join.

Both turn a comparison of positions into equality of keys, so no task gets all
rows of a key, however hot it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairnlake.session import written

#: A block of a level is 16 of the level below; eight levels span 32 bits.
BITS, LEVELS = 4, 8


def _blocks(start: Column, end: Column) -> Column:
    """array<struct<level, block>>: the aligned blocks of 16^level positions that make up start to end, the largest that fit."""

    def inside(level: int) -> tuple[Column, Column]:
        return F.shiftright(start + ((1 << (BITS * level)) - 1), BITS * level), F.shiftright(end + 1, BITS * level) - 1

    def run(level: int, low: Column, high: Column) -> Column:
        at = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(at, lambda b: F.struct(F.lit(level).alias("level"), b.alias("block")))

    out = []
    for level in range(LEVELS):
        low, high = inside(level)
        if level == LEVELS - 1:
            out.append(run(level, low, high))
            continue
        up_low, up_high = inside(level + 1)
        any_up = up_low <= up_high  # the levels above take the middle
        out.append(run(level, low, F.when(any_up, F.shiftleft(up_low, BITS) - 1).otherwise(high)))
        out.append(run(level, F.when(any_up, F.shiftleft(up_high + 1, BITS)).otherwise(high + 1), high))
    return F.when(start <= end, F.concat(*out)).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))


def points_in_ranges(points: DataFrame, ranges: DataFrame, *, key: str, point: str, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Rows of ``points`` whose ``point`` lies in a range (start to end, both in it) of the same key.

    A range is a few aligned blocks, those of overlapping ranges are the same ones and
    count once; a point lies in one block of each level. So the join is on equal
    (key, level, block), each point meets at most one row a level, and rows of one key
    are dealt by their places. Points are laid out for levels that some range has. A range of any length has at most 15 blocks a side of
    each level. Nulls lie nowhere, ranges whose end is before the start are empty.
    """
    block = ranges.select(F.col(key).alias("__key"), F.explode(_blocks(F.col(start).cast("long"), F.col(end).cast("long"))).alias("b")).where(F.col("__key").isNotNull())
    block = written(block.select("__key", F.col("b.level").alias("__level"), F.col("b.block").alias("__block")).distinct())
    there = sorted(r[0] for r in block.select("__level").distinct().collect())
    if not there:
        return points.where("false")
    levels = lambda at: F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright(at.cast("long"), BITS * i).alias("block")) for i in there])
    places = points.select(F.col(key).alias("__k"), F.col(point).alias("__p")).where("__k IS NOT NULL AND __p IS NOT NULL").distinct().withColumn("__place", F.explode(levels(F.col("__p"))))
    met = places.join(block, (F.col("__k") == F.col("__key")) & (F.col("__place.level") == F.col("__level")) & (F.col("__place.block") == F.col("__block")), "left_semi").select("__k", "__p")
    return points.join(met, (points[key] == met["__k"]) & (points[point] == met["__p"]), "left_semi")  # a place may have met blocks of several levels


def _seconds(time: str, kind: str) -> Column:
    """Whole seconds in an order that no session's time zone breaks."""
    if kind == "timestamp":
        return F.unix_seconds(time)
    days = F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400 + (0 if kind == "date" else F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time))


def as_of(left: DataFrame, right: DataFrame, *, key: str, time: str, values: list[str], seconds: int = 86_400) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` with its key at or before its time; nulls without one.

    Time is cut into pieces of ``seconds``. The last row of each key and piece is an
    aggregate that is combined before the shuffle; a window over these few rows carries
    it on to later pieces, and the window that looks at all rows is within a key's
    piece. So a hot key is as many groups as it has pieces. Of rows of ``right`` with
    one key and time that of the greatest values counts. A null key or time finds nothing.
    Both times are of one type: timestamps with or without a zone, or dates.
    """
    piece = lambda: F.floor(_seconds("__t", dict(right.dtypes)[time]) / F.lit(seconds))
    state = F.struct(F.col(time).alias("t"), *[F.col(v).alias(v) for v in values])
    r = right.select(F.col(key).alias("__k"), F.col(time).alias("__t"), state.alias("__r")).where("__k IS NOT NULL AND __t IS NOT NULL").withColumn("__p", piece())
    own = left.select(F.struct(*[left[c] for c in left.columns]).alias("__l"), F.col(key).alias("__k"), F.col(time).alias("__t")).withColumn("__p", piece())
    last = r.groupBy("__k", "__p").agg(F.max("__r").alias("__r"))
    wanted = own.select("__k", "__p").distinct().withColumn("__r", F.lit(None).cast(last.schema["__r"].dataType))
    before = W.partitionBy("__k").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    pieces = last.unionByName(wanted).groupBy("__k", "__p").agg(F.max("__r").alias("__r"))
    carried = pieces.select(F.col("__k").alias("__ck"), F.col("__p").alias("__cp"), F.last("__r", ignorenulls=True).over(before).alias("__c"))
    both = own.withColumn("__r", F.lit(None).cast(last.schema["__r"].dataType)).unionByName(r.withColumn("__l", F.lit(None).cast(own.schema["__l"].dataType)))
    # at one time, rows of the right side come first
    within = W.partitionBy("__k", "__p").orderBy("__t", F.col("__l").isNotNull(), "__r").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("__in", F.last("__r", ignorenulls=True).over(within)).where(F.col("__l").isNotNull())
    met = found.join(carried, F.col("__k").eqNullSafe(F.col("__ck")) & F.col("__p").eqNullSafe(F.col("__cp")), "left")
    seen = F.when(F.col("__k").isNotNull() & F.col("__t").isNotNull(), F.coalesce("__in", "__c"))
    return met.select("__l", seen.alias("__s")).select("__l.*", *[F.col("__s")[v].alias(v) for v in values])


def carried(rows: DataFrame, order: str, value: Column, *, own: bool = True, size: int = 100_000) -> DataFrame:
    """``rows`` with ``carried``: the last ``value`` that isn't null at a row, or only before it, in the order of an integer column without nulls.

    Rows are dealt by pieces of ``size`` of the order; what a piece ends with is an
    aggregate, and the one window over all pieces has a row for each of them.
    """
    placed = rows.withColumns({"__value": value, "__piece": F.floor(F.col(order) / F.lit(size))})
    ends = placed.groupBy("__piece").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(order))).alias("__end"))
    before = W.orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    earlier = ends.select(F.col("__piece").alias("__at"), F.last("__end", ignorenulls=True).over(before).alias("__earlier"))
    within = W.partitionBy("__piece").orderBy(order).rowsBetween(W.unboundedPreceding, 0 if own else -1)
    met = placed.withColumn("__in", F.last("__value", ignorenulls=True).over(within)).join(earlier, F.col("__piece") == F.col("__at"))
    return met.select(*[rows[c] for c in rows.columns], F.coalesce("__in", "__earlier").alias("carried"))


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` with their place from 1 in the order of a column, nulls first; of equal values any may come first.

    Range partitions are sorted apart and written, so places stay as they are; what
    lies before a partition comes from one row for each of them.
    """
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order)
    placed = written(ranged.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").select(*rows.columns, (F.col("__start") + F.col("__row") + 1).alias(name))
