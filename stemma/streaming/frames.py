"""Trace frames as a stream: counters in event time, and call depth as keyed state."""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stemma.operators.graph import new_folder

LATE = "1 day"
DEPTH_OUT = "session_id long, frames long, depth long, calls long, exceptions long"
DEPTH_STATE = "frames long, depth long, calls long, exceptions long, last long"
#: How long after its last event a session is kept.
IDLE = "7 days"


def event_stream(spark: SparkSession, path: str, late: str = LATE) -> DataFrame:
    """Events of a folder or file as a stream, in event time; ``late``: how far behind the latest an event may be."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16)
    rows = reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else reader.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def windowed_counters(events: DataFrame, window: str = "1 day") -> DataFrame:
    """Calls, returns and exceptions for each window of event time."""
    return (
        events.groupBy(F.window("ts", window).alias("w"))
        .agg(F.count_if(F.col("event_type") == "click").alias("calls"), F.count_if(F.col("event_type") == "view").alias("returns"), F.count_if(F.col("event_type") == "error").alias("exceptions"), F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), "calls", "returns", "exceptions", "n")
    )


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream gives once all that is there has been read."""
    name = f"drained_{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def daily_counters(spark: SparkSession, path: str) -> DataFrame:
    """Daily counters of all events at a path, by way of a stream."""
    return drained(windowed_counters(event_stream(spark, path)))


def session_depth(events: DataFrame, mode: str = "update", idle: str = IDLE) -> DataFrame:
    """Running frames, call depth and counters of each session (``user_id``), kept as state between micro-batches.

    A session's state goes once the watermark has passed its last event by ``idle``.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frames, depth, calls, exceptions, last = state.get if state.exists else (0, 0, 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            frames += 1
            depth = depth + 1 if kind == "click" else max(0, depth - 1) if kind == "view" else depth
            calls += kind == "click"
            exceptions += kind == "error"
        last = max(last, int(rows["ts"].max().timestamp() * 1000))
        state.update((frames, depth, calls, exceptions, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame({"session_id": [key[0]], "frames": [frames], "depth": [depth], "calls": [calls], "exceptions": [exceptions]})

    return events.withColumn("session_id", F.col("user_id")).groupBy("session_id").applyInPandasWithState(update, DEPTH_OUT, DEPTH_STATE, mode, GroupStateTimeout.EventTimeTimeout)


ORDERED_OUT = "session_id long, event_id long, ts timestamp, event_type string, depth long, late boolean"
ORDERED_STATE = "session_id array<long>, at array<long>, event_id array<long>, event_type array<string>, walked array<long>, last_at array<long>, last_event array<long>, depth array<long>"
#: Most rows of a file of a micro-batch and events of a bucket of sessions, on average.
ROWS, EVENTS = 1_000_000, 50_000
#: Stands for a null, so that columns of whole numbers stay whole in pandas.
NONE = -(1 << 63)


def ordered_depth(events: DataFrame, idle: str = IDLE, buckets: int = 64) -> DataFrame:
    """Each event once, with the call depth of its session (``user_id``) in order of time, however events arrive.

    An event waits in keyed state until the watermark has passed it; then all that
    have waited are walked in order.  A pause of more than ``idle`` starts the
    depth at 0 again, and a session's state goes when the watermark has passed its
    last event by as much.  An event older than one already walked comes out as
    ``late``, without a depth; events behind the watermark are Spark's to drop.
    Sessions are kept together in ``buckets``, whose state comes and goes once a
    micro-batch.  Times are kept in UTC.
    """
    pause = int(pd.Timedelta(idle).total_seconds() * 1_000_000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *waiting, walked, last_at, last_event, depths = state.get if state.exists else [[]] * 8
        held = list(zip(*waiting, strict=True))
        last = {s: own for s, *own in zip(walked, last_at, last_event, depths, strict=True)}
        watermark, out = state.getCurrentWatermarkMs(), []
        for pdf in batches:
            for row in zip(*(pdf[c].tolist() for c in ("session_id", "at", "event_id", "event_type")), strict=True):
                session, at, event, _ = row
                if session in last and (at, event) <= (last[session][0], last[session][1]):
                    out.append((*row, None, True))
                elif at != NONE:
                    held.append(row)
        held.sort(key=lambda h: h[1:3])
        n = bisect.bisect_left(held, watermark * 1000, key=lambda h: h[1])
        for session, at, event, kind in held[:n]:
            before, _, depth = last.get(session, (at, event, 0))
            depth = 0 if at - before > pause else depth
            depth = depth + 1 if kind == "click" else max(0, depth - 1) if kind == "view" else depth
            last[session] = (at, event, depth)
            out.append((session, at, event, kind, depth, False))
        rest = held[n:]
        waits = {h[0] for h in rest}
        ends = {s: (own[0] + pause) // 1000 + 1 for s, own in last.items()}
        last = {s: own for s, own in last.items() if s in waits or ends[s] > watermark}  # what comes to others starts at depth 0
        if rest or last:
            state.update((*([h[i] for h in rest] for i in range(4)), list(last), *([own[i] for own in last.values()] for i in range(3))))
            state.setTimeoutTimestamp(max(watermark + 1, min([h[1] // 1000 for h in rest[:1]] + [ends[s] - 1 for s in last])))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["session_id", "at", "event_id", "event_type", "depth", "late"]).astype({"depth": "Int64"})

    whole = lambda c: F.coalesce(c, F.lit(NONE))
    back = lambda c: F.when(F.col(c) != NONE, F.col(c)).alias(c)
    rows = events.select(F.pmod(F.xxhash64(F.col("user_id").cast("long")), F.lit(buckets)).alias("bucket"), whole(F.col("user_id").cast("long")).alias("session_id"), whole(F.unix_micros("ts")).alias("at"), whole(F.col("event_id").cast("long")).alias("event_id"), "event_type", "ts")
    own = rows.groupBy("bucket").applyInPandasWithState(update, "session_id long, at long, event_id long, event_type string, depth long, late boolean", ORDERED_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return own.select(back("session_id"), back("event_id"), F.timestamp_micros("at").alias("ts"), "event_type", "depth", "late")


def arriving(rows: DataFrame, order: str, batches: int) -> tuple[str, int, int]:
    """A folder with the micro-batches in which the rows arrive, by ``order``, the number of files of each and that of all rows."""
    folder, size = new_folder(rows.sparkSession), rows.count()
    edges = rows.approxQuantile(order, [i / batches for i in range(1, batches)], 0.001)
    files = -(-size // (batches * ROWS)) or 1
    at = sum((F.col(order) > e).cast("int") for e in edges) if edges else F.lit(0)
    own = rows.withColumn("__batch", at)
    for i in range(batches):
        batch = own.filter(F.col("__batch") == i).drop("__batch", order)
        (batch.coalesce(1) if files == 1 else batch.repartition(files)).write.mode("append").parquet(f"{folder}/in")
    return folder, files, size


def replayed_in_order(rows: DataFrame, order: str, late: str = LATE, idle: str = IDLE, batches: int = 6) -> DataFrame:
    """``ordered_depth`` of rows that arrive in ``order`` in several micro-batches, as a table.

    After the last of them a row far ahead, of no session, moves the watermark, so
    that all events are released; it waits for one later than itself.
    """
    spark = rows.sparkSession
    rows = rows.select("user_id", "ts", "event_id", "event_type", order)
    folder, files, size = arriving(rows, order, batches)
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for last in (False, True):
            if last:
                ahead = rows.agg(F.max("ts").alias("ts")).select(*[(F.col("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts") if c == "ts" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c != order])
                ahead.coalesce(1).write.mode("append").parquet(f"{folder}/in")
            source = spark.readStream.schema(rows.drop(order).schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
            stream = ordered_depth(source.withWatermark("ts", late), idle, max(64, size // EVENTS))
            query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return spark.read.schema(ORDERED_OUT).parquet(f"{folder}/rows").filter("session_id IS NOT NULL")


def final_depth(spark: SparkSession, path: str) -> DataFrame:
    """The last row of ``session_depth`` of each session, by way of a stream whose rows go to files and not to the driver.

    No event is late and no session idle: all of what is there counts.
    """
    stream = session_depth(event_stream(spark, path, "36500 days"), "append", "36500 days")
    rows = F.struct("frames", "depth", "calls", "exceptions")
    return written(stream).groupBy("session_id").agg(F.max(rows).alias("r")).select("session_id", "r.*")


def written(stream: DataFrame) -> DataFrame:
    """What a stream appends once all that is there has been read, as a table in the shared folder."""
    spark, folder = stream.sparkSession, new_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
