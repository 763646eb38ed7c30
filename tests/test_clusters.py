"""Ranges of a hierarchy against walks of it, names by common beginnings, kinds of lines."""

import random

import pytest
from pyspark.sql import functions as F

from stemma.functions import names
from stemma.operators import clusters


def tree_of(rng):
    """Rows (level, cluster, child) of three levels, and each leaf's clusters."""
    rows, above = [], {}
    for i in range(5):
        for j in range(rng.randrange(1, 4)):
            rows.append((0, f"a{i}", f"b{i}{j}"))
            for k in range(rng.randrange(1, 4)):
                rows.append((1, f"b{i}{j}", f"c{i}{j}{k}"))
                for n in range(rng.randrange(1, 6)):
                    leaf = f"x{len(above)}"
                    rows.append((2, f"c{i}{j}{k}", leaf))
                    above[leaf] = (f"a{i}", f"b{i}{j}", f"c{i}{j}{k}")
    return rows, above


@pytest.mark.parametrize("block", [4096, 3])
def test_what_is_below_a_cluster_is_a_range(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    rng = random.Random(4)
    rows, above = tree_of(rng)
    places, spans = clusters.nested(spark.createDataFrame(rows, "level int, cluster string, child string"))
    assert sorted(r["place"] for r in places.collect()) == list(range(len(above)))
    for cluster in ("a2", "b00", "c000"):
        assert {r["id"] for r in clusters.below(places, spans, cluster).collect()} == {x for x, up in above.items() if cluster in up}
    assert clusters.below(places, spans, "none").count() == 0
    leaves = sorted(above)
    links = [(rng.choice(leaves), rng.choice(leaves), rng.choice(["call", "import"])) for _ in range(400)]
    edges = spark.createDataFrame(links, "source_id string, target_id string, edge_type string")
    for level, top in ((1, "a1"), (2, "a3")):
        want = {}
        for s, t, kind in links:
            a, b = above[s], above[t]
            if a[0] == b[0] == top and a[level] != b[level]:
                own = want.setdefault((a[level], b[level]), {})
                own[kind] = own.get(kind, 0) + 1
        got = {(r["source"], r["target"]): (r["weight"], r["kind"]) for r in clusters.drilled_edges(places, spans, edges, top, level).collect()}
        assert got == {k: (sum(v.values()), min(v, key=lambda n: (-v[n], n))) for k, v in want.items()}
    assert clusters.drilled_edges(places, spans, edges, "none", 1).count() == 0


def test_names_by_common_beginnings(spark):
    rows = [("a", "parse_file"), ("a", "parse_text"), ("b", "alone"), ("c", "x.y.z"), ("c", "q"), ("d", "abc1"), ("d", "abc2"), ("e", "w" * 30), ("e", "v" * 30)]
    got = {r["cluster"]: r["title"] for r in clusters.prefix_names(spark.createDataFrame(rows, "cluster string, name string")).collect()}
    assert got == {"a": "parse_*", "b": "alone", "c": "q", "d": "abc1", "e": "v" * 20}


def test_kinds_of_lines(spark):
    text = '"""One line."""\n\n# note\nx = 1\n"""\nlong\n# inside\n\n"""\ny = \'\'\'a\'\'\'\n\'\'\'open\nstill\n\'\'\'\nz = 2\n'
    rows = spark.createDataFrame([(1, text), (2, ""), (3, "\n"), (4, None)], "i int, text string").select("i", names.line_kinds(F.col("text")).alias("k")).collect()
    got = {r["i"]: tuple(r["k"]) if r["k"] else None for r in rows}
    assert got == {1: (14, 2, 9, 3), 2: (0, 0, 0, 0), 3: (1, 1, 0, 0), 4: None}
