"""Turns as a stream against the batch, with events out of order and restarts."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cairnlake.operators import rollup
from cairnlake.streaming import turns

KINDS = {"opened": "view", "emitted": "purchase", "clicked": "click"}
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    dice, start = random.Random(2), datetime(2026, 1, 1)
    rows = [(i, start + timedelta(seconds=40 * i), dice.choice([1, 1, 1, 2, 3]), dice.choices(["view", "purchase", "click"], [1, 8, 2])[0]) for i in range(400)]
    sent = sorted(rows, key=lambda r: r[1] + timedelta(seconds=dice.randint(0, 1500)))  # within the hour of the watermark
    end = [(10_000 + i, start + timedelta(days=2 + i), 99, "click") for i in range(3)]
    places = {p: f"{tmp_path}/{p}" for p in ("in", "out", "state")}
    for i, part in enumerate([sent[:130], sent[130:140], sent[140:], sent[140:150], *[[e] for e in end]]):  # some events come again
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(places["in"])
        stream = turns.turn_events(spark.readStream.schema(SCHEMA).parquet(places["in"]), user="user_id", ts="ts", kind="event_type", opens="view", capped="purchase", cap=3)
        query = stream.writeStream.outputMode("append").format("parquet").option("path", places["out"]).option("checkpointLocation", places["state"]).trigger(availableNow=True).start()
        assert query.awaitTermination(120), i
    found = spark.read.parquet(places["out"])
    events = spark.createDataFrame(rows, SCHEMA)
    want = rollup.turn_counters(events, user="user_id", ts="ts", kind="event_type", opens="view", names=KINDS)
    got = turns.counters(found, KINDS)
    plain = lambda df, u: sorted((str(r[u]), r.turn, r.started, *[r[n] for n in KINDS]) for r in df.collect())
    assert plain(got.where("user <> '99'"), "user") == plain(want, "user_id")
    numbered = events.join(found.select("event_id", "turn"), "event_id").where("event_type = 'purchase'")
    capped = rollup.capped(numbered, turn=["user_id", "turn"], order=["ts", "event_id"], succeeded=F.lit(True), cap=3)
    assert sorted((r.event_id, r.accepted, r.cap_hit) for r in capped.collect()) == sorted((r.event_id, r.accepted, r.cap_hit) for r in found.where("kind = 'purchase' AND user <> '99'").collect())
    assert found.where("cap_hit").count() > 0 and found.count() == found.select("event_id").distinct().count()
