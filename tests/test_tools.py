import json

from pyspark.sql import functions as F

from stemma import cli, tools
from stemma.operators import layout, timeline
from stemma.sources import files, samples


def folder_of(root):
    for path, text in samples.PYTHON.items():
        (root / path).parent.mkdir(exist_ok=True)
        (root / path).write_text(text)
    return str(root)


def test_tools_and_resources(spark, tmp_path):
    src, db = folder_of(tmp_path), str(tmp_path / "db")
    out = json.loads(tools.call("index", {"path": src, "db": db}, spark))
    assert out["nodes_indexed"] > 10
    assert json.loads(tools.call("query", {"db": db, "cypher": "MATCH (f:Function {name: $n}) RETURN f.name AS n", "parameters": {"n": "main"}}, spark)) == [{"n": "main"}]
    assert json.loads(tools.call("hotspots", {"db": db, "limit": 1}, spark))[0]["label"] == "Function"
    assert isinstance(json.loads(tools.call("unhealthy", {"db": db}, spark)), list)
    assert set(json.loads(tools.call("impact", {"db": db, "name": "rounded", "depth": 2}, spark))) == {"depth_1", "depth_2"}
    assert json.loads(tools.resource("status", db, spark))["nodes"] >= out["nodes_indexed"]
    assert "Function" in json.loads(tools.resource("schema", db, spark))["labels"]
    for bad in (("query", {"db": db, "cypher": "nonsense"}), ("nothing", {}), ("analyze", {})):
        assert set(json.loads(tools.call(*bad, spark))) == {"error", "traceback"}


def test_graph_files(spark, tmp_path):
    nodes, edges, _ = cli.graph_of(spark, folder_of(tmp_path))
    files.save_graph(nodes, edges, str(tmp_path / "lines"))
    back_nodes, back_edges = files.load_graph(spark, str(tmp_path / "lines"))
    key = ["id", "node_type", "status", "cyclomatic_complexity"]
    assert sorted(map(str, back_nodes.select(*key).collect())) == sorted(map(str, nodes.select(*key).collect()))
    assert back_edges.count() == edges.count()
    document = files.graph_document(nodes, edges, "shop").first()["json"]
    (tmp_path / "doc.json").write_text(document)
    own_nodes, own_edges = files.saved_graph(spark, str(tmp_path / "doc.json"))
    assert sorted(map(str, own_nodes.select(*key).collect())) == sorted(map(str, nodes.select(*key).collect()))
    assert own_edges.count() == edges.count() and set(json.loads(document)) == {"name", "created_at", "nodes", "edges", "root_ids"}


def test_recordings(spark, tmp_path):
    rows = [("s", i, "call" if i % 2 else "return", f"n{i}", 10 * i) for i in range(5)]
    frames = spark.createDataFrame(rows, "session_id string, frame_index long, event_type string, node_id string, elapsed_ns long")
    for compressed in (True, False):
        path = f"{tmp_path}/rec{compressed}"
        files.save_recording(frames, path, compressed)
        back = files.recording(spark, path).select(*frames.columns)
        assert sorted(map(tuple, back.collect())) == rows


def test_session_rows_and_labels(spark):
    rows = [("s", i, "call", "n", 10**9 * i, 5 - i) for i in range(3)]
    frames = spark.createDataFrame(rows, "session_id string, frame_index long, event_type string, node_id string, elapsed_ns long, memory_bytes long").withColumn("timestamp", F.timestamp_seconds(F.col("frame_index") + 1))
    r = timeline.sessions(frames, spark.createDataFrame([("a",), ("a",), ("b",)], "file string")).select("*", timeline.session_name(F.col("started_at")).alias("name")).first()
    assert (r["total_frames"], r["file_count"], r["node_count"], r["name"]) == (3, 2, 3, "rec_19700101_000001")
    assert timeline.trace_counters(frames).first()["peak_memory_bytes"] == 5
    assert timeline.summaries(frames).filter("frame_index = 2").first()["elapsed"] == "00:02.000"
    assert timeline.frame_labels(frames).filter("frame_index = 0").first()["label"] == "Frame 1 / 3"
    assert [timeline.speed_label(s) for s in (0.5, 2, 1000)] == ["0.5x", "2x", "100x"]


def test_layout_cache(spark, tmp_path):
    nodes, links = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "b")], "a string, b string")
    first = sorted(map(tuple, layout.cached_layout(nodes, links, str(tmp_path), 1).collect()))
    assert sorted(map(tuple, layout.cached_layout(nodes, links, str(tmp_path), 1).collect())) == first
    assert len([p for p in tmp_path.iterdir() if not p.name.startswith(".")]) == 1
