"""Events out of order, late events, and sessions that end, in state that Spark keeps between micro-batches."""

import datetime as dt

from pyspark.sql import functions as F

from stemma.operators import timeline
from stemma.streaming import frames as stream

T0 = dt.datetime(2024, 1, 1)


def test_shuffled_batches_give_the_depths_of_a_sorted_table(spark):
    kinds = ["click", "click", "view", "error", "click", "view", "view"]
    rows = [(i, T0 + dt.timedelta(minutes=i), i % 5, kinds[i * 7 % 11 % 7], float(i + (i * 37) % 90)) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, arrival double")
    got = {r["event_id"]: r["depth"] for r in stream.replayed_in_order(events, "arrival", "100 minutes", "10 days", 5).collect()}
    kind = F.when(F.col("event_type") == "click", "call").when(F.col("event_type") == "view", "return").otherwise("exception")
    frames = events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("frame_index"), kind.alias("event_type"))
    assert got == {r["frame_index"]: r["depth"] for r in timeline.stack_depth(frames).collect()} and len(got) == 400


def test_late_events_come_out_apart_and_pauses_end_sessions(spark):
    hour = lambda h: T0 + dt.timedelta(hours=h)
    rows = [
        (1, hour(0), 1, "click", 0.0),
        (2, hour(1), 1, "click", 0.0),
        (3, hour(2), 2, "click", 0.0),
        (4, hour(30), 2, "click", 1.0),  # 28 hours later: a new session
        (5, hour(29), 2, "click", 2.0),  # before it, and in time
        (6, hour(60), 3, "click", 2.0),
        (7, hour(59.5), 1, "click", 3.0),
        (8, hour(100), 3, "click", 4.0),
        (9, hour(98), 3, "view", 5.0),
    ]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, arrival double")
    got = {r["event_id"]: (r["depth"], r["late"]) for r in stream.replayed_in_order(events, "arrival", "3 hours", "20 hours", 6).collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (1, False), 5: (1, False), 4: (2, False), 6: (1, False), 7: (1, False), 9: (0, False), 8: (1, False)}


def test_many_sessions_meet_python_in_few_groups(spark):
    """A late event, a pause and an end in each of 3,000 sessions, whose state is kept in far fewer rows."""
    events = spark.range(3000).selectExpr("id AS user_id", "explode(array(0, 1, 2, 50)) AS hour").selectExpr("user_id * 100 + hour AS event_id", f"timestamp'{T0}' + make_interval(0, 0, 0, 0, hour) AS ts", "user_id", "'click' AS event_type", "CASE hour WHEN 1 THEN 9.0 ELSE CAST(hour AS double) END AS arrival")
    was, kept = stream.new_folder, []
    stream.new_folder = lambda spark: kept.append(was(spark)) or kept[-1]
    try:
        got = stream.replayed_in_order(events, "arrival", "10 hours", "20 hours", 4).groupBy(F.col("event_id") % 100, "depth", "late").count().collect()
    finally:
        stream.new_folder = was
    assert sorted(map(tuple, got)) == [(0, 1, False, 3000), (1, 2, False, 3000), (2, 3, False, 3000), (50, 1, False, 3000)]
    assert 0 < spark.read.format("statestore").option("batchId", 1).load(f"{kept[0]}/state").count() <= 64
