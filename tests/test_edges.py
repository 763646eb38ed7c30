"""Edges dealt out by rows, and joins of them that carry packed ids."""

import random

from pyspark.sql import functions as F

from stemma.operators import clusters, graph
from stemma.sources import tables

SF = "/root/testdata/sf0.001"


def test_edges_are_dealt_out_by_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "LINES", 500)
    sizes = tables.edges(spark, SF).filter("edge_type = 'call'").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 700
    assert sum(r["count"] for r in sizes) == sum(tables.table(spark, SF, t).select(*keys).distinct().count() for t, keys in (("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey", "l_partkey"]), ("lineitem", ["l_partkey", "l_suppkey"])))


IDS = ["0123456789abcdef", "0123456789ABCDEF", "0123456789abcdeg", "", "a", "ü", "\x01#Eg\x89", "0" * 16, "0" * 17, None]


def test_packed_ids_are_half_as_long_and_come_back(spark):
    rows = spark.createDataFrame([(i,) for i in IDS], "id string")
    short = graph.packed(rows, "id")
    assert graph.unpacked(short, "id").collect() == rows.collect()
    assert short.distinct().count() == len(IDS)
    assert short.filter(F.octet_length("id") == 8).count() == 2


def test_joins_of_edges_carry_packed_ids(spark):
    rng = random.Random(3)
    ends = [(f"e{i}", rng.choice(IDS), rng.choice(IDS), rng.choice("xy"), 1.0) for i in range(200)]
    edges = spark.createDataFrame(ends, "id string, source_id string, target_id string, edge_type string, weight double")
    keep = IDS[:6]
    nodes = spark.createDataFrame([(i, f"c{k % 3}") for k, i in enumerate(keep)], "id string, cluster string")
    own = graph.induced(nodes, edges)
    assert sorted(map(tuple, own.select(edges.columns).collect()), key=str) == sorted([e for e in ends if e[1] in keep and e[2] in keep], key=str)
    cluster, counts = dict(nodes.collect()), {}
    for _, s, t, kind, _ in ends:
        if s in keep and t in keep and cluster[s] != cluster[t]:
            counts.setdefault((cluster[s], cluster[t]), {}).setdefault(kind, []).append(1)
    want = sorted((s, t, sum(map(len, k.values())), min(k, key=lambda x: (-len(k[x]), x))) for (s, t), k in counts.items())
    found = clusters.edges_by_kind(edges, nodes)
    assert sorted(map(tuple, found.collect())) == want
    for df in (own, found):
        assert "unhex" in df._jdf.queryExecution().optimizedPlan().toString()
