"""Intervals, search, seeking and histograms over trace frames.

A frame has ``session_id``, ``frame_index`` (from 0), ``event_type``,
``node_id`` and ``elapsed_ns``.  All operators take many sessions at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ordered():
    return W.partitionBy("session_id").orderBy("frame_index")


def _session():
    return W.partitionBy("session_id")


def intervals(frames: DataFrame) -> DataFrame:
    """Adds ``interval_ns`` since the session's previous frame."""
    return frames.withColumn("interval_ns", F.col("elapsed_ns") - F.lag("elapsed_ns").over(_ordered()))


def interval_statistics(frames: DataFrame) -> DataFrame:
    """A row for each session: frames, duration, and mean (rounded down), least and greatest interval."""
    return intervals(frames).groupBy("session_id").agg(
        F.count("*").alias("total_frames"),
        F.max_by("elapsed_ns", "frame_index").alias("duration_ns"),
        F.coalesce(F.floor(F.sum("interval_ns") / F.count("interval_ns")), F.lit(0)).alias("avg_interval_ns"),
        F.coalesce(F.min("interval_ns"), F.lit(0)).alias("min_interval_ns"),
        F.coalesce(F.max("interval_ns"), F.lit(0)).alias("max_interval_ns"),
    )


def counters(frames: DataFrame) -> DataFrame:
    """Calls and exceptions of each session."""
    return frames.groupBy("session_id").agg(F.count_if(F.col("event_type") == "call").alias("calls"), F.count_if(F.col("event_type") == "exception").alias("exceptions"))


def node_activity(frames: DataFrame) -> DataFrame:
    """For each node the calls that returned and the exceptions raised."""
    return frames.groupBy("node_id").agg(F.count_if(F.col("event_type") == "return").alias("call_count"), F.count_if(F.col("event_type") == "exception").alias("exceptions_raised"))


def next_of_type(frames: DataFrame, event_type: str) -> DataFrame:
    """Adds ``next_index``: the next later frame of a type, the frame itself if there's none."""
    later = _session().orderBy(F.desc("frame_index")).rowsBetween(W.unboundedPreceding, -1)  # a frame that grows is read once
    found = F.last(F.when(F.col("event_type") == event_type, F.col("frame_index")), ignorenulls=True).over(later)
    return frames.withColumn("next_index", F.coalesce(found, F.col("frame_index")))


def stepped(frames: DataFrame, by: int) -> DataFrame:
    """Adds ``to_index``: the frame ``by`` steps on, kept within the session."""
    last = F.count("*").over(_session()) - 1
    return frames.withColumn("to_index", F.greatest(F.lit(0), F.least(last, F.col("frame_index") + by)))


def seek_time(frames: DataFrame, times: DataFrame) -> DataFrame:
    """For (``session_id``, ``t``): the first frame at or after t, or the last one."""
    joined = times.join(frames, "session_id")
    at = F.min(F.when(F.col("elapsed_ns") >= F.col("t"), F.col("frame_index")))
    return joined.groupBy("session_id", "t").agg(F.coalesce(at, F.max("frame_index")).alias("frame_index"))


def seek_progress(frames: DataFrame, progress: float, clamp: bool = True) -> DataFrame:
    """For each session the frame at a share of its length."""
    p = max(0.0, min(1.0, progress)) if clamp else progress
    return frames.groupBy("session_id").agg((F.lit(p) * (F.count("*") - 1)).cast("long").alias("frame_index"))


def seek_frame(frames: DataFrame, index: int) -> DataFrame:
    """For each session a frame number kept within it."""
    return frames.groupBy("session_id").agg(F.greatest(F.lit(0), F.least(F.count("*") - 1, F.lit(index))).alias("frame_index"))


def frame_at(frames: DataFrame, index: int) -> DataFrame:
    return frames.filter(F.col("frame_index") == index)


def frames_between(frames: DataFrame, start: int, end: int) -> DataFrame:
    """Frames from start up to end, the end left out."""
    return frames.filter((F.col("frame_index") >= max(0, start)) & (F.col("frame_index") < end))


def indices_where(frames: DataFrame, **equal) -> DataFrame:
    """For each session the frame numbers with given values."""
    for name, value in equal.items():
        frames = frames.filter(F.col(name) == value)
    return frames.groupBy("session_id").agg(F.sort_array(F.collect_list("frame_index")).alias("indices"))


def positions(frames: DataFrame) -> DataFrame:
    """Adds ``progress``, the share of the session before each frame, and ``percent``."""
    share = F.col("frame_index") / F.greatest(F.lit(1), F.count("*").over(_session()) - 1)
    return frames.withColumn("progress", share).withColumn("percent", share * 100)


def delays(frames: DataFrame, speed: float = 1.0) -> DataFrame:
    """Adds ``delay_ns`` before a frame in a replay, speeds kept within 0.01 and 100."""
    return intervals(frames).withColumn("delay_ns", F.coalesce(F.col("interval_ns"), F.lit(0)) / max(0.01, min(100.0, speed)))


def stack_depth(frames: DataFrame) -> DataFrame:
    """Adds ``depth``: calls that haven't returned, never below 0."""
    step = F.when(F.col("event_type") == "call", 1).when(F.col("event_type") == "return", -1).otherwise(0)
    running = frames.withColumn("__s", F.sum(step).over(_ordered()))
    low = F.min("__s").over(_ordered().rowsBetween(W.unboundedPreceding, 0))
    return running.withColumn("depth", F.col("__s") - F.least(F.lit(0), low)).drop("__s")


def stack_content(frames: DataFrame) -> DataFrame:
    """Adds ``call_stack``: the nodes called and not returned from, outermost first.

    A state machine along each session; frames of a session come sorted and
    stream through, so only the stack is held.
    """
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql import types as T

    kept = [f for f in frames.schema.fields if f.name != "call_stack"]
    schema = T.StructType([*kept, T.StructField("call_stack", T.ArrayType(T.StringType()))])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, stack = None, []
        for pdf in batches:
            stacks = []
            for s, kind, node in zip(pdf["session_id"], pdf["event_type"], pdf["node_id"], strict=True):
                if s != session:
                    session, stack = s, []
                if kind == "call":
                    stack.append(str(node))
                elif kind == "return" and stack:
                    stack.pop()
                stacks.append(list(stack))
            yield pdf.assign(call_stack=stacks)

    dealt = frames.select(*[f.name for f in kept]).repartition("session_id").sortWithinPartitions("session_id", "frame_index")
    return dealt.mapInPandas(walk, schema)


def activity_histogram(frames: DataFrame, buckets: int = 100) -> DataFrame:
    """``bucket``, ``activity``, ``normalised`` of each session's course: calls weigh 1.5, exceptions 2, others 1."""
    share = F.col("frame_index").cast("double") / F.count("*").over(_session()) * buckets
    weight = F.when(F.col("event_type") == "call", 1.5).when(F.col("event_type") == "exception", 2.0).otherwise(1.0)
    own = frames.withColumn("bucket", F.floor(share)).groupBy("session_id", "bucket").agg(F.sum(weight).alias("activity"))
    return own.withColumn("normalised", F.col("activity") / F.max("activity").over(_session()))


def line_blocks(first, last, levels: int):
    """The blocks (``level``, ``block``) of 2^level lines that make up the lines from first to last: at most two of a level."""
    start = F.struct(first.cast("long").alias("a"), (last.cast("long") + 1).alias("b"), F.array().cast("array<struct<level:int,block:bigint>>").alias("found"))

    def up(s, level):
        block = lambda n: F.array(F.struct(level.alias("level"), n.alias("block")))
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        odd_a, odd_b = (s["a"] < s["b"]) & (s["a"] % 2 == 1), (s["a"] < s["b"]) & (s["b"] % 2 == 1)
        found = F.concat(s["found"], F.when(odd_a, block(s["a"])).otherwise(none), F.when(odd_b & (s["b"] - 1 >= s["a"] + odd_a.cast("long")), block(s["b"] - 1)).otherwise(none))
        a, b = s["a"] + odd_a.cast("long"), s["b"] - odd_b.cast("long")
        return F.struct(F.floor(a / 2).alias("a"), F.greatest(F.floor(b / 2), F.floor(a / 2)).alias("b"), found.alias("found"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, up, lambda s: s["found"])


def located(frames: DataFrame, nodes: DataFrame) -> DataFrame:
    """Frames (``qualified_name``, ``file``, ``lineno``) with the node they ran in.

    By qualified name, else the first node in load order (``seq``) whose lines
    in the same file hold the frame's.  A node's lines are cut into blocks of
    powers of two, of which each keeps its first node; a line is in one block of
    each size, so it meets as many rows as there are sizes, however many nodes a
    file has and however they overlap.
    """
    by_name = nodes.groupBy("qualified_name").agg(F.min_by("id", F.struct("seq", "id")).alias("by_name"))
    named = frames.join(by_name, "qualified_name", "left")
    lost = named.filter("by_name IS NULL AND lineno >= 0")
    last = max((r[0] or 0) for r in (nodes.agg(F.max(F.greatest("line", "end_line"))).first(), lost.agg(F.max("lineno")).first()))
    levels = int(last + 1).bit_length()
    spans = nodes.filter("line IS NOT NULL").select("file", F.greatest("line", F.lit(0)).alias("a"), F.coalesce("end_line", F.lit(last)).alias("b"), "id", "seq").filter("a <= b")
    blocks = spans.select("file", "id", "seq", F.explode(line_blocks(F.col("a"), F.col("b"), levels)).alias("at")).groupBy("file", "at.level", "at.block").agg(F.min(F.struct("seq", "id")).alias("node"))
    places = lost.select("file", "lineno").distinct()  # a place's node doesn't depend on the frame
    sizes = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    asked = places.select("file", "lineno", sizes.alias("level")).withColumn("block", F.floor(F.col("lineno") / F.pow(F.lit(2.0), F.col("level"))).cast("long"))
    by_line = asked.join(blocks, ["file", "level", "block"]).groupBy("file", "lineno").agg(F.min("node").alias("node")).select("file", "lineno", F.col("node.id").alias("by_line"))
    return named.join(by_line, ["file", "lineno"], "left").withColumn("node_id", F.coalesce("by_name", "by_line")).drop("by_name", "by_line")


def clock(ns) -> object:
    """Nanoseconds as mm:ss.mmm."""
    ms = F.floor(ns / 1_000_000)
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60_000), F.pmod(F.floor(ms / 1000), F.lit(60)), F.pmod(ms, F.lit(1000)))


def summaries(frames: DataFrame) -> DataFrame:
    """``session_id``, ``frame_index``, ``event_type``, ``node_id`` and the time as a clock."""
    return frames.select("session_id", "frame_index", "event_type", "node_id", clock(F.col("elapsed_ns")).alias("elapsed"))


def frame_labels(frames: DataFrame) -> DataFrame:
    """Adds ``label``: the frame's number from 1 and how many the session has."""
    return frames.withColumn("label", F.format_string("Frame %d / %d", F.col("frame_index") + 1, F.count("*").over(_session())))


def speed_label(speed: float) -> str:
    """A replay speed as shown: whole numbers without decimals."""
    kept = max(0.01, min(100.0, speed))
    return f"{kept:g}x"


def trace_counters(frames: DataFrame) -> DataFrame:
    """Calls, exceptions and the peak of ``memory_bytes`` of each session."""
    return frames.groupBy("session_id").agg(F.count_if(F.col("event_type") == "call").alias("calls"), F.count_if(F.col("event_type") == "exception").alias("exceptions"), F.coalesce(F.max("memory_bytes"), F.lit(0)).alias("peak_memory_bytes"))


def sessions(frames: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """A row for each session: its id, first time, interval statistics and the files of the graph it ran in."""
    own = interval_statistics(frames)
    if "timestamp" in frames.columns:
        own = own.join(frames.groupBy("session_id").agg(F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at")), "session_id")
    if nodes is not None:
        counts = nodes.agg(F.count_distinct("file").alias("file_count"), F.count("*").alias("node_count")).first()
        own = own.withColumn("file_count", F.lit(counts["file_count"])).withColumn("node_count", F.lit(counts["node_count"]))
    return own


def session_name(started_at) -> object:
    """The name of a recording that starts at a time."""
    return F.concat(F.lit("rec_"), F.date_format(started_at, "yyyyMMdd_HHmmss"))
