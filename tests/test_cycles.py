"""Strongly connected components against walks of small graphs, and the number of rounds on long ones."""

import random

import pytest

from stemma.operators import graph


def tarjan(links):
    """Components of nodes on cycles, loops included, by the largest."""
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())

    def reach(start):
        seen, todo = set(), [start]
        while todo:
            for b in out[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    far = {a: reach(a) for a in out}
    groups = {a: {b for b in far[a] if a in far[b]} | {a} for a in out}
    return {a: max(g) for a, g in groups.items() if len(g) > 1 or a in out[a]}


def components(spark, links, told=None):
    edges = spark.createDataFrame(links, "source_id long, target_id long")
    return {r["id"]: r["component"] for r in graph.strong_components(edges, told).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([12, 40, 90])
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice([0.9, 1.2, 1.6])))]
    links += [(1000 + i, 1000 + (i + 1) % 7) for i in range(7)] + [(3, 3), (2000, 2001), (2001, 2000), (2001, 2002)]
    assert components(spark, links) == tarjan(links)


def test_rings_on_a_string_and_a_ladder(spark):
    """Rings along a line, a ring through a hub twice, and a ladder without cycles."""
    links = [(10 * r + i, 10 * r + (i + 1) % 5) for r in range(8) for i in range(5)] + [(10 * r + 2, 10 * r + 10) for r in range(7)]
    links += [(500, 501), (501, 502), (502, 500), (500, 601), (601, 602), (602, 603), (603, 500)]
    links += [x for i in range(12) for x in ((700 + i, 701 + i), (800 + i, 801 + i), (700 + i, 801 + i))]
    assert components(spark, links) == tarjan(links)


def test_a_long_chain_with_rings_takes_few_rounds(spark):
    from pyspark.sql import functions as F

    n, rings, size = 100_000, 50, 40
    chain = spark.range(n - 1).select(F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"))
    ring = spark.range(rings * size).select((F.col("id") + n).alias("source_id"), (F.col("id") - F.col("id") % size + (F.col("id") + 1) % size + n).alias("target_id"))
    tied = spark.range(rings).select((F.col("id") * 1999).alias("source_id"), (F.col("id") * size + n).alias("target_id"))  # from the chain to each ring
    rounds = []
    got = graph.strong_components(chain.unionByName(ring).unionByName(tied), rounds.append).groupBy("component").count().collect()
    assert sorted((r["component"], r["count"]) for r in got) == [(n + (r + 1) * size - 1, size) for r in range(rings)]
    assert len(rounds) < 40, rounds


@pytest.mark.parametrize("seed", range(2))
def test_nodes_taken_out_of_chains_are_put_back(spark, seed, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 2)
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(66)]
    links += [(1000 + i, 1000 + (i + 1) % 17) for i in range(17)] + [(2000, 2001), (2001, 2000), (3000, 3001), (3001, 3002), (3002, 3000), (3001, 3003)]
    links += [(100 + i, 101 + i) for i in range(40)] + [(140, 100), (140, 7), (7, 4000), (4000, 4001), (4001, 7), (7, 4002), (4002, 7)] + links[:5]
    assert components(spark, links) == tarjan(links)


def test_chains_move_few_rows_whatever_their_length(spark, monkeypatch):
    from pyspark.sql import functions as F

    n, rows, settle = 20_000, [], graph.settled
    monkeypatch.setattr(graph, "FEW", 500, raising=False)
    monkeypatch.setattr(graph, "settled", lambda df: (out := settle(df), rows.append(out.count()))[0])
    ring = spark.range(n).select(F.col("id").alias("source_id"), ((F.col("id") + 1) % n).alias("target_id"))
    assert graph.strong_components(ring).filter(F.col("component") == n - 1).count() == n
    assert sum(rows) < 10 * n, rows  # a row for each node and jump would be 15
