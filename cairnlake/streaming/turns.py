"""Turns and the cap of a turn as a stream.

Events of a user arrive in any order within the watermark. They wait in the user's
state until the watermark has passed them, and a timer then takes them in order of
time and id: an event of kind ``opens`` begins a turn, what comes before the first
is no turn's, and each event of kind ``capped`` counts towards its turn's cap. Each
event comes out once, when its turn and its place under the cap are final, so the
output is appended, and counters of turns are an aggregation of it. State is a
user's turn, count and waiting events; a restart goes on from the checkpoint.

Events without a user, time or id are left out; those later than the watermark are
dropped, as by any stateful operator. One event id counts once while it waits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairnlake.operators.rollup import TURN_CAP


def turn_events(events: DataFrame, *, user: str, ts: str, kind: str, opens: str, capped: str, id_col: str = "event_id", late: str = "1 hour", cap: int = TURN_CAP) -> DataFrame:
    """(user, event_id, ts, kind, turn, accepted, cap_hit) of a stream's events, each once it is final; the last two are null for other kinds."""
    rows = events.select(F.col(user).cast("string").alias("user"), F.col(id_col).cast("long").alias("event_id"), F.col(ts).cast("timestamp").alias("ts"), F.col(kind).alias("kind")).dropna(subset=["user", "event_id", "ts"])

    def taken(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, passed, raw = state.get if state.exists else (0, 0, "{}")
        waiting = json.loads(raw)  # id: [microseconds, kind]
        for frame in frames:
            for event, at, what in zip(frame.event_id.tolist(), frame.ts.astype("datetime64[us]").astype("int64").tolist(), frame.kind.tolist()):
                waiting[str(event)] = [at, what]
        mark = state.getCurrentWatermarkMs()
        ready = sorted((at, int(event), what) for event, (at, what) in waiting.items() if at < mark * 1000)
        out = []
        for at, event, what in ready:
            del waiting[str(event)]
            if what == opens:
                turn, passed = turn + 1, 0
            good = hit = None
            if what == capped:
                passed += 1
                good, hit = passed <= cap, passed > cap
            if turn:
                out.append((key[0], event, pd.Timestamp(at, unit="us"), what, turn, good, hit))
        state.update((turn, passed, json.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(min(at for at, _ in waiting.values()) // 1000 + 1, mark + 1))
        made = pd.DataFrame(out, columns=["user", "event_id", "ts", "kind", "turn", "accepted", "cap_hit"])
        yield made.astype({"accepted": "object", "cap_hit": "object"})

    grouped = rows.withWatermark("ts", late).groupBy("user")
    return grouped.applyInPandasWithState(taken, "user string, event_id long, ts timestamp, kind string, turn long, accepted boolean, cap_hit boolean", "turn long, passed long, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def counters(taken: DataFrame, names: dict[str, str]) -> DataFrame:
    """(user, turn, started, counts of each kind, cap_hit) from the events that came out."""
    return taken.groupBy("user", "turn").agg(F.min("ts").alias("started"), *[F.count_if(F.col("kind") == k).alias(n) for n, k in names.items()], F.coalesce(F.bool_or("cap_hit"), F.lit(False)).alias("cap_hit"))
