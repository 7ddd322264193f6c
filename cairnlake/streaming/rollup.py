"""The activity rollup as a stream: weekly counts by event time, late events within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Windows of a week begin on Mondays; the epoch began on a Thursday.
MONDAY = "4 days"


def weekly_counts(events: DataFrame, *, ts: str = "ts", kind: str = "event_type", late: str = "1 day") -> DataFrame:
    """(week_of, kind, n) of a stream or table of events; weeks are final once the watermark passes them."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    week = F.window(ts, "7 days", "7 days", MONDAY)
    return rows.groupBy(week, kind).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("week_of"), kind, "n")
