import pytest
from pyspark.sql import functions as F

from stemma.operators import layout, timeline
from stemma.sources import tables
from stemma.streaming import frames as stream

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frames(spark):
    kinds = ["call", "call", "return", "exception", "return", "return", "call"]
    rows = [("s", i, k, f"n{i % 2}", t) for i, (k, t) in enumerate(zip(kinds, [0, 10, 10, 25, 40, 41, 99], strict=True))] + [("one", 0, "line", "n", 0)]
    return spark.createDataFrame(rows, "session_id string, frame_index long, event_type string, node_id string, elapsed_ns long")


def column(df, name):
    return [r[name] for r in df.filter("session_id = 's'").orderBy("frame_index").collect()]


def test_intervals(frames):
    got = {r["session_id"]: r for r in timeline.interval_statistics(frames).collect()}
    assert tuple(got["s"])[1:] == (7, 99, 16, 0, 58) and tuple(got["one"])[1:] == (1, 0, 0, 0, 0)
    assert column(timeline.delays(frames, 0.5), "delay_ns") == [0, 20, 0, 30, 30, 2, 116]


def test_search(frames, spark):
    assert column(timeline.next_of_type(frames, "exception"), "next_index") == [3, 3, 3, 3, 4, 5, 6]
    assert column(timeline.next_of_type(frames, "call"), "next_index") == [1, 6, 6, 6, 6, 6, 6]
    assert column(timeline.stepped(frames, 3), "to_index") == [3, 4, 5, 6, 6, 6, 6]
    times = spark.createDataFrame([("s", -5), ("s", 11), ("s", 1000), ("one", 7)], "session_id string, t long")
    got = {(r["session_id"], r["t"]): r["frame_index"] for r in timeline.seek_time(frames, times).collect()}
    assert got == {("s", -5): 0, ("s", 11): 3, ("s", 1000): 6, ("one", 7): 0}
    at = lambda df: {r["session_id"]: r["frame_index"] for r in df.collect()}
    assert at(timeline.seek_progress(frames, 0.5)) == {"s": 3, "one": 0} and at(timeline.seek_progress(frames, 7))["s"] == 6
    assert at(timeline.seek_progress(frames, 2, clamp=False))["s"] == 12 and at(timeline.seek_frame(frames, -3))["s"] == 0
    assert timeline.frames_between(frames, -2, 3).count() == 4 and timeline.frame_at(frames, 9).count() == 0
    assert timeline.indices_where(frames, event_type="call").first()["indices"] == [0, 1, 6]


def test_stack(frames):
    assert column(timeline.stack_depth(frames), "depth") == [1, 2, 1, 1, 0, 0, 1]
    assert column(timeline.stack_content(frames), "call_stack") == [["n0"], ["n0", "n1"], ["n0"], ["n0"], [], [], ["n0"]]


def test_histogram_truncates_in_doubles(spark):
    hundred = spark.range(100).select(F.lit("s").alias("session_id"), F.col("id").alias("frame_index"), F.lit("line").alias("event_type"))
    got = {r["bucket"]: r["activity"] for r in timeline.activity_histogram(hundred).collect()}
    assert got == {b: float(sum(int(i / 100 * 100) == b for i in range(100))) for b in got}


def test_located(spark):
    nodes = spark.createDataFrame([("a", "m.f", "m.py", 1, 9, 0), ("b", "m.g", "m.py", 3, 5, 1), ("c", "m.h", "m.py", 20, None, 2)], "id string, qualified_name string, file string, line long, end_line long, seq long")
    frames = spark.createDataFrame([(1, "m.g", "m.py", 4), (2, "?", "m.py", 4), (3, "?", "m.py", 500), (4, "?", "m.py", 15), (5, "?", "z.py", 4), (6, "?", "m.py", 4)], "k long, qualified_name string, file string, lineno long")
    assert {r["k"]: r["node_id"] for r in timeline.located(frames, nodes).collect()} == {1: "b", 2: "a", 3: "c", 4: None, 5: None, 6: "a"}


def test_clock(spark):
    assert spark.range(1).select(timeline.clock(F.lit(125_042_000_000)).alias("t")).first()["t"] == "02:05.042"


def test_stream_equals_batch(spark):
    streamed = {r["start"]: (r["calls"], r["n"]) for r in stream.daily_counters(spark, f"{DIR}/events.parquet").collect()}
    events = tables.table(spark, DIR, "events").withColumn("d", F.date_trunc("day", F.col("ts").cast("timestamp")))
    batch = {r["d"]: (r["calls"], r["n"]) for r in events.groupBy("d").agg(F.count_if(F.col("event_type") == "click").alias("calls"), F.count("*").alias("n")).collect()}
    assert streamed == batch


def test_stream_state(spark):
    rows = stream.drained(stream.session_depth(stream.event_stream(spark, f"{DIR}/events.parquet").dropDuplicates(["event_id", "ts"])), "update")
    last = {r["session_id"]: r["frames"] for r in rows.groupBy("session_id").agg(F.max("frames").alias("frames")).collect()}
    truth = {r["user_id"]: r["count"] for r in tables.table(spark, DIR, "events").groupBy("user_id").count().collect()}
    assert last == truth


def test_layouts(spark):
    one = layout.sphere_points(spark.range(1), "id").first()
    assert (one["x"], one["y"], one["z"]) == (0.0, 0.0, 0.0)
    many = layout.sphere_points(spark.range(50), "id", digits=6).collect()
    assert all(abs(r["x"] ** 2 + r["y"] ** 2 + r["z"] ** 2 - 1) < 1e-4 for r in many)
    nodes = spark.createDataFrame([(c,) for c in "abcd"], "id string")
    links = spark.createDataFrame([("a", "b"), ("c", "d")], "a string, b string")
    rows = layout.force_layout(nodes, links, iterations=2).collect()
    assert len(rows) == 4 and all(-50.01 <= r[c] <= 50.01 for r in rows for c in "xyz")
    assert layout.layout_key(nodes, links) == layout.layout_key(nodes.orderBy(F.desc("id")), links) != layout.layout_key(nodes, links.limit(1))
