"""Resolution of names that parsers left as placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions.scoring import edge_id

CALLABLE = ["function", "method", "class"]


def unique_names(nodes: DataFrame) -> DataFrame:
    """``name``, ``target``: names that exactly one function, method or class has."""
    own = nodes.filter(F.col("node_type").isin(CALLABLE)).select("name", "id").distinct()
    return own.groupBy("name").agg(F.count("*").alias("n"), F.first("id").alias("target")).filter("n = 1").drop("n")


def resolve_calls(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls of builtin placeholders go to the unique definition of that name; placeholders nothing points to go.

    An ambiguous or unknown name stays, edges of other kinds are left alone.
    """
    placeholders = nodes.filter("node_type = 'builtin'").select("id", "name")
    moves = placeholders.join(unique_names(nodes), "name").select(F.col("id").alias("target_id"), F.col("target").alias("__to"))
    joined = edges.join(moves, "target_id", "left")
    to = F.when((F.col("edge_type") == "call") & F.col("__to").isNotNull(), F.col("__to")).otherwise(F.col("target_id"))
    moved = joined.withColumn("target_id", to).drop("__to").withColumn("id", edge_id(F.col("edge_type"), F.col("source_id"), F.col("target_id"))).select(*edges.columns)
    used = moved.select(F.col("target_id").alias("id")).distinct()
    orphans = placeholders.select("id").join(used, "id", "left_anti")
    return nodes.join(orphans, "id", "left_anti").select(*nodes.columns), moved


def last_definitions(nodes: DataFrame, order: str = "seq") -> DataFrame:
    """``name``, ``target``: of the functions, methods and classes of a name the one loaded last."""
    own = nodes.filter(F.col("node_type").isin(CALLABLE))
    return own.groupBy("name").agg(F.max_by("id", F.struct(order, "id")).alias("target"))


def orphan_placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Builtins that no edge points to."""
    return nodes.filter("node_type = 'builtin'").join(edges.select(F.col("target_id").alias("id")), "id", "left_anti")
