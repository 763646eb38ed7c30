"""What a viewer draws of a graph: nodes, edges and moving particles as rows, with their colours and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.scoring import looked_up
from stemma.schema import EDGE_COLOURS, NODE_COLOURS, NODE_SIZES, STATUS_COLOURS, VALUE_COLOURS

GREY, WHITE = (0.5, 0.5, 0.5), (1.0, 1.0, 1.0)


def colour_of_value(data_type: Column) -> Column:
    """The colour of a particle by the type it carries, type arguments left out."""
    return looked_up(F.substring_index(data_type, "[", 1), VALUE_COLOURS, WHITE)


def colour_of_status(status: Column) -> Column:
    return looked_up(status, STATUS_COLOURS, GREY)


def glow(level: Column) -> Column:
    """How bright a node of an activity level is, 1 at most."""
    return F.least(F.lit(1.0), level)


def pulse(level: Column) -> Column:
    """Beats a second of a node of an activity level."""
    return level * 2.0


def drawn_nodes(nodes: DataFrame, activity: DataFrame | None = None) -> DataFrame:
    """``id``, ``name``, ``type``, ``size``, ``colour``, ``health``, ``glow``; ``activity``: (``id``, ``level``) of nodes at work."""
    level = F.lit(0.0)
    if activity is not None:
        nodes = nodes.join(activity.select("id", F.col("level").cast("double").alias("__level")), "id", "left")
        level = F.coalesce("__level", F.lit(0.0))
    kind = F.col("node_type")
    return nodes.select("id", "name", kind.alias("type"), looked_up(kind, NODE_SIZES, 1.0).alias("size"), looked_up(kind, NODE_COLOURS, GREY).alias("colour"), F.col("status").alias("health"), glow(level).alias("glow"))


def drawn_edges(edges: DataFrame) -> DataFrame:
    """``id``, ``source``, ``target``, ``type``, ``weight`` and ``colour`` of each edge."""
    return edges.select("id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("edge_type").alias("type"), "weight", looked_up(F.col("edge_type"), EDGE_COLOURS, GREY).alias("colour"))


def drawn_particles(particles: DataFrame, size: float = 0.2) -> DataFrame:
    """``id``, ``edge``, ``position``, ``colour`` and ``size`` of each particle."""
    return particles.select("id", F.col("edge_id").alias("edge"), "position", colour_of_value(F.col("data_type")).alias("colour"), F.lit(size).alias("size"))


def moved(particles: DataFrame, seconds: float) -> DataFrame:
    """The particles that are still under way some seconds later, at their new ``position`` and ``age``.

    A particle ends where its edge does (position 1), or once it is older than its ``lifetime``.
    """
    later = particles.withColumn("position", F.col("position") + F.col("speed") * seconds).withColumn("age", F.col("age") + seconds)
    return later.filter((F.col("position") < 1.0) & (F.col("age") <= F.col("lifetime")))
