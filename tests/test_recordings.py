"""Recordings in ranges of frames: written as many rows, read by many tasks and only where asked."""

import pytest
from pyspark.sql import functions as F

from stemma.sources import files


@pytest.fixture
def frames(spark):
    own = spark.range(5000).select(F.lit("long").alias("session_id"), F.col("id").alias("frame_index"))
    own = own.unionByName(spark.range(40).select(F.lit("short").alias("session_id"), F.col("id").alias("frame_index")))
    return own.select("session_id", F.timestamp_seconds(F.col("frame_index")).alias("timestamp"), "frame_index", F.concat(F.lit("n"), "frame_index").alias("node_id"), F.lit("call").alias("event_type"), F.create_map(F.lit("k"), F.lit("v")).alias("event_data"), F.array(F.lit("a")).alias("call_stack"), (F.col("frame_index") * 7).alias("elapsed_ns"))


def rows(df, like):
    return sorted(str(r) for r in df.select(*like.columns).collect())


def test_ranges_come_back_whole_and_are_pruned(spark, tmp_path, monkeypatch, frames):
    monkeypatch.setattr(files, "RANGE", 1000)
    monkeypatch.setattr(files, "FILE_ROWS", 300)
    for compressed in (True, False):
        path = f"{tmp_path}/r{compressed}"
        files.save_recording(frames, path, compressed)
        assert rows(files.recording(spark, path), frames) == rows(frames, frames)
        written = [p for p in (tmp_path / f"r{compressed}").glob("*/part-*")]
        assert len(written) >= 17
        longest = spark.read.text(path).agg(F.max(F.length("value"))).first()[0]
        assert longest < 1000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "16k")
    try:
        assert files.recording(spark, path).rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    part = files.recording(spark, path, 1500, 2200)
    assert rows(part, frames) == rows(frames.filter("frame_index BETWEEN 1500 AND 2200"), frames)
    scan = next(line for line in part._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(frame_range" in scan


def test_documents_are_read_too(spark, tmp_path, frames):
    own = frames.filter("frame_index < 30")
    files.save_document(own, f"{tmp_path}/d")
    assert rows(files.recording(spark, f"{tmp_path}/d"), own) == rows(own, own)
    assert files.recording(spark, f"{tmp_path}/d", 5, 9).count() == 10
