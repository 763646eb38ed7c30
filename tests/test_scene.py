import io
import json

import pytest
from pyspark.sql import functions as F

from stemma import server, tools
from stemma.operators import scene, timeline
from stemma.sources import samples
from stemma.streaming import frames, record

PROGRAM = '''class Box:
    def size(self, n):
        return n + 1


def parts(n):
    yield n
    yield n + 1


def fails(n):
    raise ValueError("no " + str(n))


def main(n):
    for p in parts(n):
        Box().size(p)
    try:
        fails(n)
    except ValueError:
        pass
    return "x" * 300
'''


def test_particles_end_at_their_edge_or_age(spark):
    rows = [("a", "e", 0.0, 1.0, 0.0, 5.0, "int"), ("b", "e", 0.5, 1.0, 0.0, 5.0, "list[str]"), ("c", "e", 0.0, 0.1, 4.9, 5.0, "bytes"), ("d", "e", 0.0, 0.1, 4.5, 5.0, None)]
    own = spark.createDataFrame(rows, "id string, edge_id string, position double, speed double, age double, lifetime double, data_type string")
    got = {r["id"]: (r["position"], r["age"]) for r in scene.moved(own, 0.5).collect()}
    assert got == {"a": (0.5, 0.5), "d": (0.05, 5.0)}
    colours = {r["id"]: tuple(r["colour"]) for r in scene.drawn_particles(own).collect()}
    assert colours == {"a": (0.3, 0.5, 1.0), "b": (0.8, 0.4, 0.8), "c": scene.WHITE, "d": scene.WHITE}


def test_glow_and_pulse(spark):
    row = spark.createDataFrame([(0.25,), (3.0,)], "level double").select(scene.glow(F.col("level")).alias("g"), scene.pulse(F.col("level")).alias("p"))
    assert [tuple(r) for r in row.collect()] == [(0.25, 0.5), (1.0, 6.0)]


@pytest.fixture
def program(tmp_path):
    path = tmp_path / "prog.py"
    path.write_text(PROGRAM)
    space: dict = {}
    exec(compile(PROGRAM, str(path), "exec"), space)
    return path, space["main"]


def test_a_running_program_becomes_frames(spark, program, tmp_path):
    path, main = program
    seen = []
    with record.Recorder(str(tmp_path / "rec"), [str(path)], session_id="s", per_file=4, each=seen.append) as own:
        main(1)
        json.dumps({})  # of no file that is recorded
    main(2)
    rows = sorted(record.recorded(spark, str(tmp_path / "rec")).collect(), key=lambda r: r["frame_index"])
    assert len(rows) == own.count == len(seen) and [r["frame_index"] for r in rows] == list(range(len(rows)))
    kinds = [r["event_type"] for r in rows]
    assert kinds.count("call") == kinds.count("return") == own.calls and own.exceptions == kinds.count("exception") >= 1
    first, last = rows[0], rows[-1]
    assert (first["qualified_name"], first["event_type"], first["local_vars"]) == ("prog.main", "call", {"n": "1"})
    assert (last["event_type"], last["event_data"]["return_type"], len(last["event_data"]["return_value"]), list(last["call_stack"])) == ("return", "str", 103, [])
    size = next(r for r in rows if r["qualified_name"] == "prog.Box.size")
    assert list(size["call_stack"]) == ["prog.main", "prog.Box.size"] and size["session_id"] == "s"
    failed = next(r for r in rows if r["event_type"] == "exception")
    assert failed["event_data"]["exception_message"] == "no 1" and "ValueError" in failed["event_data"]["traceback"]
    times = [r["elapsed_ns"] for r in rows]
    assert times == sorted(times)
    stats = timeline.interval_statistics(record.recorded(spark, str(tmp_path / "rec"))).first()
    assert stats["total_frames"] == len(rows)


def test_recorded_frames_stream_and_find_their_nodes(spark, program, tmp_path):
    path, main = program
    with record.Recorder(str(tmp_path / "rec"), [str(path)], per_file=3):
        main(1)
    streamed = frames.written(record.frame_stream(spark, str(tmp_path / "rec")))
    whole = record.recorded(spark, str(tmp_path / "rec"))
    assert streamed.count() == whole.count() > 10
    nodes = spark.createDataFrame([("m", "prog.main", str(path), 15, 23, 0), ("z", "other", str(path), 1, 3, 1)], "id string, qualified_name string, file string, line long, end_line long, seq long")
    found = {(r["qualified_name"], r["node_id"]) for r in record.recorded(spark, str(tmp_path / "rec"), nodes).collect()}
    assert ("prog.main", "m") in found and ("prog.Box.size", "z") in found


def test_values_are_shown_short():
    class Broken:
        def __repr__(self):
            raise RuntimeError

    assert record.shown("a" * 98) == repr("a" * 98) and record.shown("a" * 99) == "'" + "a" * 99 + "..." and record.shown(Broken()) == "<Broken: RuntimeError>"


def test_server_speaks_the_protocol(spark, tmp_path):
    assert set(server.OFFERED) == set(tools.TOOLS)
    for path, text in samples.PYTHON.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    db = str(tmp_path / "db")
    call = lambda i, method, **params: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    lines = [
        call(1, "initialize", protocolVersion="2024-11-05"),
        json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}),
        call(2, "tools/list"),
        call(3, "tools/call", name="index", arguments={"path": str(tmp_path)}),
        call(4, "tools/call", name="query", arguments={"cypher": "nonsense"}),
        call(5, "tools/call", name="nothing"),
        call(6, "resources/list"),
        call(7, "resources/read", uri="stemma://status"),
        call(8, "resources/read", uri="stemma://else"),
        call(9, "unheard/of"),
        "not json",
        "[]",
        "",
    ]
    out = io.StringIO()
    server.serve(lines, out, db, spark)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    by = {g["id"]: g for g in got if g["id"]}
    assert len(got) == 11 and set(by) == set(range(1, 10))
    assert by[1]["result"]["serverInfo"]["name"] == "stemma" and len(by[2]["result"]["tools"]) == 8
    assert not by[3]["result"]["isError"] and by[4]["result"]["isError"]
    assert [by[i]["error"]["code"] for i in (5, 8, 9)] == [-32602, -32002, -32601]
    assert len(by[6]["result"]["resources"]) == 2
    assert json.loads(by[7]["result"]["contents"][0]["text"])["nodes"] > 10
    assert [g["error"]["code"] for g in got if g["id"] is None] == [-32700, -32600]
