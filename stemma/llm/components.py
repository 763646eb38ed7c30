"""Connected components of a table of links, without a driver-side structure.

Every node starts with the least node it is linked to.  In each round a node
takes the least label among its neighbours and then the label of its label, so
labels travel along paths at doubling lengths; it ends when a round changes
nothing.  Each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.shared import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) for every node of a link; the component is its least node.

    Links with a null end and links of a node to itself are ignored, repeated
    links count once, an empty table gives an empty result.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    both = written(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("component")))
    while True:
        known = labels.select(F.col("node").alias("y"), F.col("component").alias("near"))
        near = both.join(known, "y").groupBy(F.col("x").alias("node")).agg(F.min("near").alias("near"))
        better = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("at"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("beyond"))
        moved = written(better.join(jump, "at", "left").select("node", "was", F.least("at", F.coalesce("beyond", "at")).alias("component")))
        if moved.filter("was <> component").limit(1).count() == 0:
            return labels
        labels = moved.select("node", "component")
