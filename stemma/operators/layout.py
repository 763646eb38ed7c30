"""Positions for nodes: on a sphere, or by forces; cached by what is laid out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.operators.graph import settled

REPULSION = 1000.0
ATTRACTION = 0.01
SIDE = 100.0
#: Halvings of the box that holds all nodes; a cell is taken as one body where its side is under OPENING times its distance.
LEVELS, OPENING = 16, 0.8


def sphere_points(rows: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """``x``, ``y``, ``z`` evenly on the unit sphere, in the order of the key; one row alone is at the origin.

    Positions are global, so rows are numbered by partitions: a count for each
    partition of the sorted rows, and numbers within it.
    """
    sorted_rows = settled(rows.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("__p", F.spark_partition_id()))
    counts = sorted_rows.groupBy("__p").agg(F.count("*").alias("__c"))
    before = counts.withColumn("__b", F.coalesce(F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    total = sorted_rows.count()
    i = F.col("__b") + F.row_number().over(W.partitionBy("__p").orderBy(key)) - 1
    at = sorted_rows.join(before.select("__p", "__b"), "__p").withColumn("i", i)
    if total <= 1:
        return at.select(key, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    theta = 2 * F.pi() * F.col("i") / ((1 + F.sqrt(F.lit(5.0))) / 2)
    phi = F.acos(1 - 2 * (F.col("i") + 0.5) / total)
    flat = lambda c: F.round(c, digits) + 0.0
    return at.select(key, flat(F.cos(theta) * F.sin(phi)).alias("x"), flat(F.sin(theta) * F.sin(phi)).alias("y"), flat(F.cos(phi)).alias("z"))


def layout_key(nodes: DataFrame, links: DataFrame) -> str:
    """A digest of the nodes and links that are laid out, for a cache of layouts.

    Made of sums of row hashes, so nothing is gathered or sorted.
    """
    n = nodes.agg(F.count("*"), F.sum(F.xxhash64("id").cast("decimal(38,0)"))).first()
    e = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    import hashlib

    return hashlib.md5(f"{n[0]}:{n[1]}|{e[0]}:{e[1]}".encode()).hexdigest()


def octree(points: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``level``, ``code``, ``n``, ``x``, ``y``, ``z``, ``side``: the cells of a linear octree over points (``id``, ``x``, ``y``, ``z``).

    A cell's code is the Morton code of its place among the cells of its level,
    in a cube that holds all points; it has the number and the mean of its points.
    Only cells within a cell of two points or more are kept, so the tree is as
    deep as the points are close, up to ``levels``.  No points, no cells.
    """
    placed, side = morton(points, levels)
    own = placed.select("x", "y", "z", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"), F.col("code").alias("whole"))
    cell = F.floor(F.col("whole") / F.pow(F.lit(8.0), levels - F.col("level"))).cast("long")
    cells = own.groupBy("level", cell.alias("code")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyz"])
    above = cells.filter("n > 1").select((F.col("level") + 1).alias("level"), F.col("code").alias("parent"))
    inner = cells.withColumn("parent", F.floor(F.col("code") / 8).cast("long")).join(above, ["level", "parent"], "left_semi")
    kept = inner.select("level", "code", "n", "x", "y", "z").unionByName(cells.filter("level = 0").select("level", "code", "n", "x", "y", "z"))
    return kept.withColumn("side", F.lit(side) / F.pow(F.lit(2.0), F.col("level")))


def morton(points: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, float]:
    """Points with the ``code`` of their cell of the last level, x's bits highest, and the side of the cube."""
    box = points.agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if box["lox"] is None:
        return points.withColumn("code", F.lit(0).cast("long")), 0.0
    side = max(max(box[f"hi{c}"] - box[f"lo{c}"] for c in "xyz"), 1e-9)
    cells = 1 << levels
    at = {c: F.least(F.lit(cells - 1), F.floor((F.col(c) - F.lit(box[f"lo{c}"])) / F.lit(side) * cells)).cast("long") for c in "xyz"}
    code = F.lit(0).cast("long")
    for bit in range(levels):
        for k, c in enumerate("zyx"):
            code = code + F.shiftleft(F.shiftright(at[c], bit).bitwiseAND(1), 3 * bit + k)
    return points.withColumn("code", code), side


def repulsion(points: DataFrame, levels: int = LEVELS, opening: float = OPENING) -> tuple[DataFrame, DataFrame]:
    """(``id``, ``fx``, ``fy``, ``fz``, ``energy``, ``bodies``) and the octree: what all other points do to each.

    Down the tree, level by level, each point meets the children of the cells it
    has opened by a join on the cell.  A cell that is far for its side, or has one
    point, acts as one body at its mean; others are opened.  A cell of the last
    level acts whole, but for the point itself.  Points far from all others make
    the tree deeper and no cell fuller.
    """
    placed, _ = morton(points, levels)
    placed = settled(placed.select("id", "x", "y", "z", "code"))
    tree = settled(octree(points, levels))
    depth = tree.agg(F.max("level")).first()[0]
    met = None
    opened = placed.select("id", "x", "y", "z", F.col("code").alias("own"), F.lit(None).cast("long").alias("parent"))
    for level in range((depth if depth is not None else -1) + 1):
        cells = tree.filter(F.col("level") == level).select(F.floor(F.col("code") / 8).cast("long").alias("parent"), F.col("code").alias("cell"), "n", "side", *[F.col(c).alias(f"o{c}") for c in "xyz"])
        if level == 0:
            pairs = opened.drop("parent").join(F.broadcast(cells.drop("parent")))  # one row
        else:
            pairs = opened.join(cells, "parent").drop("parent")
        within = F.floor(F.col("own") / F.pow(F.lit(8.0), F.lit(levels - level))).cast("long") == F.col("cell")
        d = F.sqrt(sum((F.col(c) - F.col(f"o{c}")) ** 2 for c in "xyz"))
        last = level == levels
        single = (F.col("n") == 1) | F.lit(last)
        far = ~within & (F.col("side") < opening * d)
        judged = settled(pairs.withColumn("within", within).withColumn("acts", single | far))
        rest = F.col("n") - F.col("within").cast("int")
        centre = [F.when(F.col("within"), (F.col("n") * F.col(f"o{c}") - F.col(c)) / rest).otherwise(F.col(f"o{c}")).alias(f"o{c}") for c in "xyz"]
        acting = judged.filter(F.col("acts") & (rest > 0)).select("id", "x", "y", "z", rest.alias("n"), *centre)
        met = acting if met is None else met.unionByName(acting)
        opened = judged.filter("NOT acts").select("id", "x", "y", "z", "own", F.col("cell").alias("parent"))
    if met is None:
        return points.select("id", *[F.lit(0.0).alias(c) for c in ("fx", "fy", "fz", "energy")], F.lit(0).cast("long").alias("bodies")).limit(0), tree
    d2 = F.greatest(F.lit(0.01), sum((F.col(c) - F.col(f"o{c}")) ** 2 for c in "xyz"))
    push = [(F.col("n") * REPULSION / d2 * (F.col(c) - F.col(f"o{c}")) / F.sqrt(d2)).alias(f"f{c}") for c in "xyz"]
    force = met.select("id", *push, (F.col("n") * REPULSION / F.sqrt(d2)).alias("energy"))
    return force.groupBy("id").agg(*[F.sum(f"f{c}").alias(f"f{c}") for c in "xyz"], F.sum("energy").alias("energy"), F.count("*").alias("bodies")), tree


def force_layout(nodes: DataFrame, links: DataFrame, iterations: int = 100, seed: int = 1) -> DataFrame:
    """``id``, ``x``, ``y``, ``z`` after repulsion between all nodes and attraction along links.

    Each node starts at a place given by a hash of its id and the seed.  Far nodes
    repel by the cells of an octree (``repulsion``), so the cost of a step follows
    the nodes and the depth of the tree, and not the pairs.
    """
    at = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1_000_003)) / 1_000_003.0 * SIDE
    state = settled(nodes.select("id").distinct().select("id", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), *[F.lit(0.0).alias(v) for v in ("vx", "vy", "vz")]))
    both = settled(links.select(F.col("a").alias("id"), F.col("b").alias("o")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("o"))))
    for step in range(iterations):
        damping = 0.9 - 0.4 * step / max(1, iterations - 1)
        push, _ = repulsion(state)
        other = state.select(F.col("id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"))
        pulled = both.join(state.select("id", "x", "y", "z"), "id").join(other, "o")
        pull = [(ATTRACTION * (F.col(f"o{c}") - F.col(c))).alias(f"f{c}") for c in "xyz"]
        force = push.select("id", "fx", "fy", "fz").unionByName(pulled.select("id", *pull)).groupBy("id").agg(*[F.sum(f"f{c}").alias(f"f{c}") for c in "xyz"])
        moved = state.join(force, "id", "left").fillna(0.0)
        speed = {c: (F.col(f"v{c}") + F.col(f"f{c}")) * damping for c in "xyz"}
        state = settled(moved.select("id", *[(F.col(c) + speed[c]).alias(c) for c in "xyz"], *[speed[c].alias(f"v{c}") for c in "xyz"]))
    box = state.agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if box["lox"] is None:
        return state.select("id", "x", "y", "z")
    span = max(box[f"hi{c}"] - box[f"lo{c}"] for c in "xyz") or 1.0
    return state.select("id", *[((F.col(c) - (box[f"lo{c}"] + box[f"hi{c}"]) / 2) / span * SIDE).alias(c) for c in "xyz"])


def cached_layout(nodes: DataFrame, links: DataFrame, folder: str, iterations: int = 100, seed: int = 1) -> DataFrame:
    """The layout of a graph, from ``folder`` if it has been laid out before with the same parameters."""
    spark = nodes.sparkSession
    path = f"{folder.rstrip('/')}/{layout_key(nodes, links)}-{iterations}-{seed}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        force_layout(nodes, links, iterations, seed).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
