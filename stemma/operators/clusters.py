"""Hierarchies of clusters: by directory, then by modularity; roll-ups and drill-down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.functions.names import prefixes, string_prefix, top_directory
from stemma.functions.scoring import cluster_size, looked_up
from stemma.operators.communities import partition
from stemma.operators.graph import numbered, packed, settled
from stemma.schema import STATUS_COLOURS

STATES = ["healthy", "stressed", "inflamed", "necrotic", "cancerous"]
TARGET = 100
LEVELS = 10
RESOLUTION = 0.5
ROUNDS = 8
FLAT = 5000
#: Places that are looked up together.
BLOCK = 4096
COUNTERS = ["total_nodes", "total_lines", "total_functions", "total_classes", *STATES]


def dominant(counts: dict[str, object]):
    """The state with the highest count; ties and nothing at all go to the first."""
    top = F.greatest(*counts.values())
    out = F.lit(STATES[-1])
    for state in reversed(STATES):
        out = F.when(counts[state] == top, state).otherwise(out)
    return out


def rolled_up(members: DataFrame) -> DataFrame:
    """Nodes (``cluster``, ``node_type``, ``status``, ``lines_of_code``) as one row for each cluster."""
    states = [F.count_if(F.col("status") == s).alias(s) for s in STATES]
    own = members.groupBy("cluster").agg(
        F.count("*").alias("total_nodes"),
        F.coalesce(F.sum("lines_of_code"), F.lit(0)).alias("total_lines"),
        F.count_if(F.col("node_type").isin("function", "method")).alias("total_functions"),
        F.count_if(F.col("node_type") == "class").alias("total_classes"),
        *states,
    )
    return described(own)


def summed_up(clusters: DataFrame, parents: DataFrame) -> DataFrame:
    """Clusters as one row for each parent (``cluster``, ``parent``)."""
    own = clusters.join(parents, "cluster").groupBy(F.col("parent").alias("cluster")).agg(*[F.sum(c).alias(c) for c in COUNTERS])
    return described(own)


def described(own: DataFrame) -> DataFrame:
    rated = own.withColumn("health_score", F.when(F.col("total_nodes") == 0, 100.0).otherwise(F.col("healthy") / F.col("total_nodes") * 100))
    rated = rated.withColumn("dominant_health", dominant({s: F.col(s) for s in STATES})).withColumn("size", cluster_size(F.col("total_nodes")))
    return rated.withColumn("colour", looked_up(F.col("dominant_health"), STATUS_COLOURS, (0.5, 0.5, 0.8)))


def contracted(links: DataFrame, members: DataFrame) -> DataFrame:
    """``a`` < ``b``, ``w``: links between clusters of (``id``, ``cluster``)."""
    left, right = members.select(F.col("id").alias("a"), F.col("cluster").alias("ca")), members.select(F.col("id").alias("b"), F.col("cluster").alias("cb"))
    ends = links.join(left, "a").join(right, "b").filter("ca <> cb")
    weight = F.col("w") if "w" in links.columns else F.lit(1.0)
    return ends.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum(weight).alias("w"))


def edges_by_kind(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``source``, ``target``, ``weight``, ``kind``: edges between clusters of (``id``, ``cluster``), how many there are, and the kind of most of them (ties to the least)."""
    places, own = packed(members.select("id", "cluster"), "id"), packed(edges.select("source_id", "target_id", "edge_type"), "source_id", "target_id")
    ends = own.join(places.select(F.col("id").alias("source_id"), F.col("cluster").alias("source")), "source_id").drop("source_id").join(places.select(F.col("id").alias("target_id"), F.col("cluster").alias("target")), "target_id")
    kinds = ends.filter("source <> target").groupBy("source", "target", "edge_type").agg(F.count("*").alias("n"))
    return kinds.groupBy("source", "target").agg(F.sum("n").alias("weight"), F.min(F.struct(-F.col("n"), F.col("edge_type"))).alias("most")).select("source", "target", "weight", F.col("most.edge_type").alias("kind"))


def prefix_names(members: DataFrame) -> DataFrame:
    """``cluster``, ``title``: what the names of all members begin with, if that is more than three characters, else the least name's first part.

    All names begin with what the least and the greatest begin with.
    """
    ends = members.groupBy("cluster").agg(F.min("name").alias("lo"), F.max("name").alias("hi"), F.count("*").alias("size"))
    shared = string_prefix(F.col("lo"), F.col("hi"))
    part = F.when(F.contains("lo", F.lit(".")), F.substring_index("lo", ".", 1)).otherwise(F.substring("lo", 1, 20))
    return ends.select("cluster", F.when(F.col("size") == 1, F.col("lo")).when(F.length(shared) > 3, F.concat(shared, F.lit("*"))).otherwise(part).alias("title"))


def nested(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``id``, ``place``) of the leaves of a hierarchy, and (``level``, ``cluster``, ``low``, ``high``) of its clusters.

    Leaves are numbered along the tree, so what is below a cluster, at any depth,
    is a range of numbers.  ``tree``: (``level``, ``cluster``, ``child``), a child
    being a cluster of the next level or, at the last, a leaf.
    """
    depth = tree.agg(F.max("level")).first()[0] or 0
    own = tree.filter(F.col("level") == depth).select(F.col("child").alias("id"), F.array("cluster").alias("above"))
    for level in range(depth - 1, -1, -1):
        up = tree.filter(F.col("level") == level).select("cluster", F.col("child").alias("first"))
        own = own.withColumn("first", F.col("above")[0]).join(up, "first", "left").select("id", F.concat(F.array("cluster"), F.col("above")).alias("above"))
    ordered = own.withColumn("way", F.concat(F.array_join("above", "\x00"), F.lit("\x00"), F.col("id")))
    places = settled(numbered(ordered, "way", "place").select("id", "above", "place"))
    spans = places.select("place", F.posexplode("above").alias("level", "cluster")).groupBy("level", "cluster").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    return places.select("id", "place"), spans


def below(places: DataFrame, spans: DataFrame, cluster: str) -> DataFrame:
    """``id``, ``place`` of all leaves below a cluster, at whatever depth: a range of places."""
    span = spans.filter(F.col("cluster") == cluster).agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
    return places.filter(F.col("place").between(span["low"], span["high"]) if span["low"] is not None else F.lit(False))


def drilled_edges(places: DataFrame, spans: DataFrame, edges: DataFrame, cluster: str, level: int) -> DataFrame:
    """``source``, ``target``, ``weight``, ``kind`` among the clusters of a level below a cluster: both ends are in its range."""
    inside = below(places, spans, cluster)
    top = spans.filter(F.col("cluster") == cluster).agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
    few = spans.filter((F.col("level") == level) & F.col("low").between(top["low"] or 0, top["high"] if top["high"] is not None else -1))
    return edges_by_kind(edges, _owners(inside, few))


def _owners(places: DataFrame, spans: DataFrame) -> DataFrame:
    """(``id``, ``cluster``): the span that holds a place, the last one that begins before it; spans don't overlap."""
    marks = spans.select(F.col("low").alias("place"), F.lit(None).cast("string").alias("id"), "cluster").unionByName(places.select("place", "id", F.lit(None).cast("string").alias("cluster")))
    block = F.floor(F.col("place") / BLOCK)
    dealt = marks.withColumn("block", block)
    # spans that reach into further blocks are begun again in each
    again = spans.select(F.explode(F.sequence(F.floor(F.col("low") / BLOCK) + 1, F.greatest(F.floor(F.col("high") / BLOCK), F.floor(F.col("low") / BLOCK) + 1))).alias("block"), "cluster", "high").filter(F.col("block") * BLOCK <= F.col("high"))
    dealt = dealt.select("block", "place", "id", "cluster").unionByName(again.select("block", (F.col("block") * BLOCK).cast("long").alias("place"), F.lit(None).cast("string").alias("id"), "cluster"))
    order = W.partitionBy("block").orderBy("place", F.col("cluster").isNull()).rowsBetween(W.unboundedPreceding, 0)  # BLOCK places and the spans that begin among them
    return dealt.withColumn("cluster", F.last("cluster", True).over(order)).filter("id IS NOT NULL AND cluster IS NOT NULL").select("id", "cluster")


def hierarchy(nodes: DataFrame, links: DataFrame, target: int = TARGET) -> DataFrame:
    """``level`` (0 the coarsest), ``cluster``, ``child`` (nodes at the finest level).

    The finest level groups files by top directory; while a level has more than
    ``target`` clusters it is partitioned again, until that shrinks it by less
    than a tenth.  A root joins what remains.
    """
    base = settled(nodes.select("id", top_directory(F.coalesce("file", F.lit(""))).alias("cluster")))
    levels = [base.select("cluster", F.col("id").alias("child"))]
    own = settled(contracted(links, base))
    ids = settled(base.select(F.col("cluster").alias("id")).distinct())
    count = ids.count()
    while count > target and len(levels) < LEVELS:
        found = settled(partition(ids, own, RESOLUTION, ROUNDS).withColumnRenamed("community", "cluster"))
        names = found.groupBy("cluster").agg(F.concat(F.lit(f"{len(levels)}:"), F.min("id")).alias("name"))
        found = settled(found.join(names, "cluster").select("id", F.substring(F.md5("name"), 1, 16).alias("cluster")))
        fewer = found.select("cluster").distinct().count()
        if fewer > 0.9 * count:
            break
        levels.append(found.select("cluster", F.col("id").alias("child")))
        own, ids, count = settled(contracted(own, found)), settled(found.select(F.col("cluster").alias("id")).distinct()), fewer
    if count > 1:
        levels.append(ids.select(F.lit("root").alias("cluster"), F.col("id").alias("child")))
    out = None
    for i, level in enumerate(reversed(levels)):
        rows = level.select(F.lit(i).alias("level"), "cluster", "child")
        out = rows if out is None else out.unionByName(rows)
    return out


def at_level(tree: DataFrame, level: int) -> DataFrame:
    """Clusters of a level, none if there's no such level."""
    return tree.filter(F.col("level") == level).select("cluster").distinct()


def children(tree: DataFrame, cluster: str) -> DataFrame:
    return tree.filter(F.col("cluster") == cluster).select("level", "child")


def view(nodes: DataFrame, edges: DataFrame, tree: DataFrame, level: int = 0, most: int = FLAT) -> DataFrame:
    """``id`` of what is shown: all nodes if there are few, else the clusters of a level."""
    return nodes.select("id") if nodes.limit(most + 1).count() <= most else at_level(tree, level).withColumnRenamed("cluster", "id")


def drilled(nodes: DataFrame, edges: DataFrame, tree: DataFrame, cluster: str) -> tuple[DataFrame, DataFrame]:
    """The children of a cluster (``id``) and the edges among them."""
    from stemma.operators.graph import induced

    own = children(tree, cluster).select(F.col("child").alias("id"))
    leaves = nodes.join(own, "id", "left_semi")
    return own, induced(leaves.select("id"), edges)


def directories(paths: DataFrame, path: str = "path") -> DataFrame:
    """``directory``, ``parent``, ``depth``, ``n`` nodes below: the tree of all path prefixes, files included."""
    rows = paths.select(F.explode(prefixes(F.col(path))).alias("directory"))
    own = rows.groupBy("directory").agg(F.count("*").alias("n"))
    parts = F.split("directory", "/")
    return own.select("directory", F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).alias("parent"), F.size(parts).cast("long").alias("depth"), "n")


def roots(tree: DataFrame) -> DataFrame:
    """The directories to show first: below the common prefix, drilling down while there is just one."""
    level = tree.filter("parent IS NULL")
    while True:
        few = level.limit(2).collect()
        if len(few) != 1:
            return level
        below = tree.filter(F.col("parent") == few[0]["directory"])
        if below.limit(1).count() == 0:
            return level
        level = below


def expanded(tree: DataFrame, directory: str) -> DataFrame:
    return tree.filter(F.col("parent") == directory)
