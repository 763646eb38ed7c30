"""Forces by the octree against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from stemma.operators import layout


def test_forces_against_all_pairs_with_an_outlier(spark):
    rng = np.random.default_rng(1)
    at = rng.random((2000, 3)) * 100
    at[7] = [1e5, -3e4, 5e4]
    at[8] = at[9]
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "id long, x double, y double, z double")
    force, tree = layout.repulsion(points)
    rows = force.orderBy("id").collect()
    gap = at[:, None] - at[None, :]
    d2 = np.maximum((gap**2).sum(-1), 0.01)
    want = (layout.REPULSION * gap / (d2 * np.sqrt(d2))[..., None]).sum(1)
    got = np.array([[r["fx"], r["fy"], r["fz"]] for r in rows])
    error = np.linalg.norm(got - want, axis=1) / np.linalg.norm(want, axis=1)
    assert np.delete(error, [8, 9]).mean() < 0.05
    energy = (layout.REPULSION / np.sqrt(d2)).sum() - layout.REPULSION / 0.1 * len(at)
    assert abs(sum(r["energy"] for r in rows) / energy - 1) < 0.02
    assert np.mean([r["bodies"] for r in rows]) < 200
    assert tree.filter("level = 0").first()["n"] == 2000


def test_layout_of_few_nodes(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    links = spark.createDataFrame([("a", "b")], "a string, b string")
    got = {r["id"]: (r["x"], r["y"], r["z"]) for r in layout.force_layout(nodes, links, iterations=3).collect()}
    assert len(got) == 3 and all(abs(v) <= 50 + 1e-6 for p in got.values() for v in p)
    assert layout.force_layout(nodes.limit(0), links.limit(0), iterations=2).count() == 0
    one = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "id long, x double, y double, z double")
    force, tree = layout.repulsion(one)
    assert force.count() == 0 and tree.count() == 1
    assert layout.repulsion(one.filter(F.lit(False)))[1].count() == 0
