import pytest
from pyspark.sql import functions as F

from stemma.operators import graph, timeline
from stemma.plans import cypher, store
from stemma.sources import files, python_ast


def test_relations_are_created_for_every_match(spark, tmp_path):
    people = spark.createDataFrame([(str(i), "function", f"f{i}", f"m.f{i}") for i in range(4)] + [("t", "class", "T", "m.T")], "id string, node_type string, name string, qualified_name string")
    none = spark.createDataFrame([], "id string, source_id string, target_id string, edge_type string, weight double")
    own = store.GraphStore(spark, str(tmp_path / "g"))
    own.save(people, none)
    made = cypher.run(own, "MATCH (a:Function), (b:Class) CREATE (a)-[:CodeRelation {kind:'call'}]->(b)")
    assert made.count() == 4
    assert own.edges().count() == 4
    with pytest.raises(cypher.QueryError):
        cypher.run(own, "MATCH (a), (b:Class) CREATE (a)-[:CodeRelation {kind:'call'}]->(b)")


def test_recordings_come_back_whole(spark, tmp_path):
    schema = "session_id string, timestamp timestamp, frame_index long, node_id string, event_type string, event_data map<string,string>, local_vars map<string,string>, call_stack array<string>, elapsed_ns long"
    rows = spark.createDataFrame([("s", i, f"n{i}", i * 10) for i in range(12)], "session_id string, frame_index long, node_id string, elapsed_ns long").selectExpr(
        "session_id", "timestamp_seconds(1700000000 + frame_index) AS timestamp", "frame_index", "node_id", "'call' AS event_type", "map('k', node_id) AS event_data", "map('x', '1') AS local_vars", "array('a', node_id) AS call_stack", "elapsed_ns"
    )
    files.save_recording(rows, str(tmp_path / "r"))
    back = files.recording(spark, str(tmp_path / "r"))
    assert {f.name for f in back.schema} == {f.split()[0] for f in schema.split(", ")}
    key = lambda df: sorted(str(r.asDict()) for r in df.select(*sorted(back.columns)).collect())
    assert key(back) == key(rows)


def test_numbers_follow_the_order(spark):
    got = graph.numbered(spark.range(1000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("k")), "k").collect()
    assert [r["n"] for r in sorted(got, key=lambda r: r["k"])] == list(range(1000))


def test_next_of_type_falls_back_to_the_frame(spark):
    frames = spark.createDataFrame([("s", i, "exception" if i in (3, 7) else "call") for i in range(10)], "session_id string, frame_index long, event_type string")
    got = {r["frame_index"]: r["next_index"] for r in timeline.next_of_type(frames, "exception").collect()}
    assert got == {0: 3, 1: 3, 2: 3, 3: 7, 4: 7, 5: 7, 6: 7, 7: 7, 8: 8, 9: 9}


@pytest.mark.parametrize(
    "text, name",
    [("a.b[c]", "a.b[c]"), ("f()", "f"), ("f(x, k=1, **z)", "f(x, k=1)"), ("(a, b)", "a, b"), ("[a, -b]", "[a, -b]"), ("a | b", "a | b"), ("a @ b", "a | b"), ("g(*xs)", "g(*xs)"), ("not a", ""), ("'q'", "'q'"), ("f().g", "f.g")],
)
def test_expression_names(text, name):
    import ast

    assert python_ast.rendered(ast.parse(text, mode="eval").body) == name
