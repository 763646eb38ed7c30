"""Joins that must not meet all pairs of a key: lines in spans, variables in inputs, paths in paths."""

import random

from pyspark.sql import functions as F

from stemma.operators import flow, paths, timeline


def test_blocks_make_up_their_lines(spark):
    spans = [(a, b) for a in range(0, 20) for b in range(a, 37, 3)] + [(5, 100_000)]
    rows = spark.createDataFrame(spans, "a int, b int").select("a", "b", timeline.line_blocks(F.col("a"), F.col("b"), 17).alias("f")).collect()
    for r in rows:
        lines = [n for x in r["f"] for n in range(x["block"] << x["level"], (x["block"] + 1) << x["level"])]
        assert sorted(lines) == list(range(r["a"], r["b"] + 1))
        assert len(r["f"]) <= 2 * 18


def test_lines_find_their_first_node(spark):
    rng = random.Random(3)
    nodes = [("f%d" % (i % 2), a := rng.randrange(1, 400), rng.choice([None, a + rng.randrange(0, 80)]) if i % 9 == 0 else a + rng.randrange(0, 80), f"n{i}", i, f"q{i}") for i in range(300)]
    frames = [("f%d" % (i % 3), rng.randrange(0, 500), "q7" if i == 5 else f"z{i}") for i in range(200)] + [("f0", None, None), (None, 3, "q9")]
    got = timeline.located(spark.createDataFrame(frames, "file string, lineno int, qualified_name string"), spark.createDataFrame(nodes, "file string, line int, end_line int, id string, seq int, qualified_name string"))
    for r in got.collect():
        named = [n for n in nodes if n[5] == r["qualified_name"]]
        holds = [n for n in nodes if n[0] == r["file"] and r["lineno"] is not None and n[1] <= r["lineno"] <= (n[2] if n[2] is not None else 10**9)]
        assert r["node_id"] == (named[0][3] if named else min(holds, key=lambda n: n[4])[3] if holds else None)
    assert got.count() == len(frames)


def test_overlapping_nodes_of_one_file_stay_few_rows(spark):
    nodes = spark.range(10_000).select(F.lit("f").alias("file"), (F.col("id") % 50).cast("int").alias("line"), (F.col("id") % 50 + 50_000).cast("int").alias("end_line"), F.col("id").cast("string").alias("id"), F.col("id").alias("seq"), F.lit("q").alias("qualified_name"))
    frames = spark.range(100_000).select(F.lit("f").alias("file"), F.col("id").cast("int").alias("lineno"), F.lit("none").alias("qualified_name"))
    got = timeline.located(frames, nodes)
    assert got.agg(F.count("node_id")).first()[0] == 50_050 and got.filter("lineno = 3").first()["node_id"] == "0"


def test_dependencies_against_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abc", k=rng.randrange(0, 8)))
    rows = [("f%d" % (i % 4), i, [word() for _ in range(rng.randrange(3))], [rng.choice([None, word() + word() + word()]) for _ in range(rng.randrange(3))]) for i in range(80)]
    table = spark.createDataFrame(rows, "file string, step int, outputs array<string>, inputs array<string>")
    want = sorted((f, a, b, v) for f, a, out, _ in rows for g, b, _, ins in rows if f == g and a < b for v in out if v and any(t and v in t for t in ins))
    assert sorted(map(tuple, flow.data_dependencies(table).collect())) == want and len(want) > 50
    words = [("f", i, ["".join(rng.choices("abcdefghij", k=9))], ["".join(rng.choices("abcdefghij", k=60))]) for i in range(300)]
    pairs = 300 * 299 // 2
    assert flow.candidate_dependencies(spark.createDataFrame(words, table.schema)).count() * 20 < pairs


def test_a_hub_on_every_path_brings_few_together(spark):
    hub = [["hub", f"a{i}", f"b{i % 700}", f"c{i}"] for i in range(10_000)] + [["hub", f"a{i}", f"c{i}"] for i in range(500)]
    table = spark.createDataFrame([(p,) for p in hub], "path array<string>")
    met = paths.containment(table)
    assert met.count() < 20 * len(hub)
    covered = met.filter(paths.is_subsequence(F.col("short"), F.col("long"))).select("short").distinct()
    assert covered.count() == 500


def test_containment_against_all_pairs(spark):
    rng = random.Random(6)
    own = sorted({tuple(rng.sample("abcdefg", rng.randrange(2, 6))) for _ in range(120)})
    within = lambda s, t: all(x in it for it in [iter(t)] for x in s)
    want = {s for s in own if any(len(t) > len(s) and within(s, t) for t in own)}
    met = paths.containment(spark.createDataFrame([(list(p),) for p in own], "path array<string>"))
    got = {tuple(r["short"]) for r in met.filter(paths.is_subsequence(F.col("short"), F.col("long"))).collect()}
    assert got == want and want
