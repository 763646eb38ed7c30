"""Lookups, degrees, health, statistics, induced subgraphs, impact and cycles."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.functions import scoring
from stemma.schema import KINDS, LOOKUP_ORDER, STATUSES, TABLE_OF_KIND


#: Rows from which on a table lies in buckets, and most rows of a bucket.
BUCKETED, BUCKET = 1_000_000, 2_000_000
#: Most nodes of chains whose pointers are doubled; of more, nodes are taken out first.
FEW = 200_000


def new_folder(spark: SparkSession) -> str:
    """A new folder in the shared folder of the cluster, which goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/stemma-{spark.sparkContext.applicationId}"
    folder = f"{base.rstrip('/')}/stemma-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage of iterations, survives lost executors."""
    spark = df.sparkSession
    folder = f"{new_folder(spark)}/rows"
    df.write.option("compression", "zstd").parquet(folder)  # ids are hexadecimal: half their size
    return spark.read.schema(df.schema).parquet(folder)


def released(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing will read again."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent().getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Buckets:
    """``rows`` as a table in the shared folder that lies by a key, so that joins on it move only the other side; few rows lie as they come."""

    def __init__(self, rows: DataFrame, key: str, count: int):
        spark = rows.sparkSession
        self.name = None
        if count < BUCKETED:
            self.rows = settled(rows)
            return
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        n = least * -(-count // (least * BUCKET))
        self.name, folder = f"stemma_{uuid.uuid4().hex}", f"{new_folder(spark)}/rows"
        rows.repartition(n, key).write.bucketBy(n, key).option("compression", "zstd").option("path", folder).saveAsTable(self.name)
        self.rows = spark.table(self.name)

    def drop(self) -> None:
        released(self.rows)
        if self.name:
            self.rows.sparkSession.sql(f"DROP TABLE {self.name}")


def where(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns have the given values."""
    for name, value in equal.items():
        df = df.filter(F.col(name) == value)
    return df


def degrees(edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """``id``, ``fan_out``, ``fan_in`` of every endpoint, from one aggregation of both ends."""
    own = edges.filter(F.col("edge_type").isin(kinds)) if kinds else edges
    ends = own.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.o").alias("fan_out"), F.sum("e.i").alias("fan_in"))


def with_health(nodes: DataFrame, edges: DataFrame, score: Column) -> DataFrame:
    """Adds ``score``, ``status`` and ``notes``; ``score`` is an expression on the nodes."""
    callers = edges.filter("edge_type = 'call'").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("callers"))
    selves = edges.filter("source_id = target_id AND edge_type IN ('import', 'import_type_only', 'call')").select(F.col("source_id").alias("id")).distinct().withColumn("self", F.lit(True))
    joined = nodes.withColumn("score", score).join(callers, "id", "left").join(selves, "id", "left")
    status = scoring.health_status(F.col("node_type"), F.col("name"), F.col("qualified_name"), F.col("callers"), F.col("self"), F.col("score"))
    judged = joined.withColumn("status", status)
    return judged.withColumn("notes", scoring.health_notes(F.col("status"), F.col("self"), F.col("score"))).drop("callers", "self")


def statistics(nodes: DataFrame) -> DataFrame:
    """One row: counts by kind and status, lines, complexity, depth; averages are over all nodes."""
    kinds = [F.count_if(F.col("node_type") == k).alias(f"n_{k}") for k in KINDS]
    states = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    rest = [
        F.count("*").alias("total_nodes"),
        F.coalesce(F.sum("lines_of_code"), F.lit(0)).alias("total_lines"),
        F.coalesce(F.avg(F.coalesce("cyclomatic_complexity", F.lit(0))), F.lit(0.0)).alias("avg_complexity"),
        F.coalesce(F.max("cyclomatic_complexity"), F.lit(0)).alias("max_complexity"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
        F.count_if(F.col("cyclomatic_complexity") >= 10).alias("n_hotspots"),
    ]
    return nodes.agg(*rest, *kinds, *states)


def health_summary(statuses: DataFrame) -> DataFrame:
    """One row: the share of each status."""
    total = F.greatest(F.count("*"), F.lit(1))
    return statuses.agg(*[(F.count_if(F.col("status") == s) / total).alias(s) for s in STATUSES])


def packed(rows: DataFrame, *names: str) -> DataFrame:
    """Rows with text ids in half their bytes, for joins that carry them: 16 hexadecimal digits as the 8 bytes they stand for, other ids behind nine zero bytes, so that none become equal."""
    short = lambda c: F.when((F.octet_length(c) == 16) & F.unhex(c).isNotNull() & (F.col(c) == F.lower(c)), F.unhex(c)).otherwise(F.concat(F.unhex(F.lit("00" * 9)), F.encode(c, "UTF-8")))
    texts = [c for c in names if rows.schema[c].dataType.typeName() == "string"]
    return rows.withColumns({c: short(c) for c in texts}) if texts else rows


def unpacked(rows: DataFrame, *names: str) -> DataFrame:
    """The ids that ``packed`` was given."""
    long = lambda c: F.when(F.octet_length(c) == 8, F.lower(F.hex(c))).otherwise(F.decode(F.substring(c, 10, 1 << 30), "UTF-8"))
    short = [c for c in names if rows.schema[c].dataType.typeName() == "binary"]
    return rows.withColumns({c: long(c) for c in short}) if short else rows


def _code(c: str) -> Column:
    half = lambda at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1) - F.lit(1 << 31), 32).bitwiseOR(half(9))


def _text(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c.bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")


#: Ids that have a whole number of their own, which stand in the same order.
_SHORT = "^[0-9a-f]{16}$"


def coded(ids: DataFrame) -> tuple[Callable[[str], Column], Callable[[Column], Column]]:
    """Ids of 16 hexadecimal digits as whole numbers of the same order, and back; other ids stay what they are."""
    if ids.schema["id"].dataType.typeName() != "string" or ids.filter(f"id IS NULL OR NOT id RLIKE '{_SHORT}'").limit(1).count():
        return F.col, lambda c: c
    return _code, _text


def settled_links(links: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
    """``source_id``, ``target_id`` as a settled table, with ids as whole numbers if all can be, and what makes ids of them again."""
    ends = ["source_id", "target_id"]
    if all(links.schema[c].dataType.typeName() == "string" for c in ends):
        short = F.coalesce(F.col("source_id").rlike(_SHORT), F.lit(True)) & F.coalesce(F.col("target_id").rlike(_SHORT), F.lit(True))
        rows = settled(links.select(*ends, short.alias("short")).select(*[_code(c).alias(c) for c in ends], "short"))
        if rows.filter("NOT short").limit(1).count() == 0:
            return rows.drop("short"), _text
        released(rows)
    return settled(links.select(*ends)), lambda c: c


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    names = [c for c in ("id", "source_id", "target_id") if c in edges.columns]
    if edges.schema["source_id"].dataType.typeName() != "string":
        names = []
    else:
        edges = settled(edges)  # ids that are still to be made would be made again in each filter that the joins push down to them
    ids = packed(nodes.select("id"), "id") if names else nodes.select("id")
    kept = packed(edges, *names).join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return unpacked(kept, *names)


def hotspots(nodes: DataFrame, limit: int = 10, kinds: list[str] | None = None) -> DataFrame:
    """The most complex functions, ties by id."""
    own = nodes.filter(F.col("node_type").isin(kinds or ["function"]) & (F.col("cyclomatic_complexity") > 0))
    return own.orderBy(F.desc("cyclomatic_complexity"), "id").limit(limit)


def complex_nodes(nodes: DataFrame, least: int = 10) -> DataFrame:
    """All nodes of at least a complexity, the most complex first."""
    return nodes.filter(F.col("cyclomatic_complexity") >= least).orderBy(F.desc("cyclomatic_complexity"), "id")


def attention(nodes: DataFrame, limit: int = 20) -> DataFrame:
    """The first nodes, by id, whose status asks for attention."""
    return nodes.filter(~F.col("status").isin("healthy", "unknown")).orderBy("id").limit(limit)


def contents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, and the directories and files that nodes come from."""
    folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    own = nodes.agg(F.count("*").alias("nodes"), F.count_distinct(F.when(F.col("file").isNotNull(), folder)).alias("directories"), F.count_distinct("file").alias("files"))
    return own.join(F.broadcast(edges.agg(F.count("*").alias("edges")))).select("nodes", "edges", "directories", "files")  # one row each


def numbered(rows: DataFrame, by: str, name: str = "n") -> DataFrame:
    """Adds ``name``: places from 0 in the order of a column of unique values, by prefix sums over ranges of it."""
    parts = settled(rows.repartitionByRange(by).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__size"))  # a row for each range
    before = sizes.withColumn("__before", F.sum("__size").over(W.orderBy("__part")) - F.col("__size")).drop("__size")
    own = F.row_number().over(W.partitionBy("__part").orderBy(by)) - 1
    return parts.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")


def unhealthy(nodes: DataFrame, below: float = 0.5) -> DataFrame:
    """Functions and methods with a score under the bound, lowest first."""
    return nodes.filter(F.col("node_type").isin("function", "method") & (F.col("score") < below)).orderBy("score", "id")


def dead_code(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("status") == "necrotic")


def found_by_name(nodes: DataFrame, name: str) -> DataFrame:
    """The id that a name stands for: the first label in the order of lookup, then the least id."""
    rank = F.lit(len(LOOKUP_ORDER))
    for i, label in enumerate(LOOKUP_ORDER):
        rank = F.when(F.col("node_type").isin([k for k, t in TABLE_OF_KIND.items() if t == label]), i).otherwise(rank)
    ranked = nodes.filter(F.col("name") == name).withColumn("rank", rank).filter(F.col("rank") < len(LOOKUP_ORDER))
    return ranked.orderBy("rank", "id").limit(1).select("id")


def impact(edges: DataFrame, targets: DataFrame, direction: str = "upstream", max_depth: int = 3) -> DataFrame:
    """``id``, ``depth``, ``edge_type`` of what is reached from the targets (``id``), level by level.

    Every node once, at its least depth, with the least kind of the edges that
    reached it there; the targets themselves are left out.  A level is one join
    of the frontier with the edges, and a table of its own.
    """
    here, there = ("target_id", "source_id") if direction == "upstream" else ("source_id", "target_id")
    steps = settled(edges.select(F.col(here).alias("at"), F.col(there).alias("id"), "edge_type"))
    seen = settled(targets.select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("edge_type")).dropDuplicates(["id"]))
    frontier, levels = seen, [seen]
    for depth in range(1, max_depth + 1):
        reached = steps.join(frontier.select(F.col("id").alias("at")), "at").groupBy("id").agg(F.min("edge_type").alias("edge_type"))
        for level in levels:
            reached = reached.join(level.select("id"), "id", "left_anti")
        frontier = settled(reached.select("id", F.lit(depth).alias("depth"), "edge_type"))
        levels.append(frontier)
    out = levels[1]
    for level in levels[2:]:
        out = out.unionByName(level)
    return out


def linked_groups(links: DataFrame, told: Callable[[str], None] | None = None) -> DataFrame:
    """``id``, ``least``: every node of the links (``a``, ``b``) with the least node of its connected group.

    A label goes to the neighbours and to the label's label in one round, so it travels at doubling lengths.
    """
    both = settled(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = settled(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("least")))
    while True:
        if told:
            told("group")
        near = both.join(label.select(F.col("id").alias("b"), F.col("least").alias("near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        found = label.join(near, "id").select("id", F.col("least").alias("was"), F.least("least", "near").alias("at"))
        far = label.select(F.col("id").alias("at"), F.col("least").alias("far"))
        moved = settled(found.join(far, "at", "left").select("id", "was", F.least("at", F.coalesce("far", "at")).alias("least")))
        label = moved.select("id", "least")
        if moved.filter("was <> least").limit(1).count() == 0:
            return label


def thinned(state: DataFrame, told: Callable[[str], None] | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Chains with nodes taken out until FEW are left, and what was taken out in each round, with the neighbours it had then.

    A node goes if its hash is above those of its neighbours in the chain, and these
    become neighbours.  At least a third goes on average, so all rounds
    together move three times the nodes, and not as often as a chain is long.  A
    ring's last node stays.
    """
    size, taken = state.count(), []
    while size > FEW:
        if told:
            told("thin")
        above = lambda c: F.xxhash64("id", F.lit(len(taken))) > F.xxhash64(c, F.lit(len(taken)))  # noqa: E731, B023
        goes = (~F.col("back_open") | above("back")) & (~F.col("forth_open") | above("forth"))
        out = state.filter(goes)
        ahead = out.filter("back_open").select(F.col("back").alias("id"), F.col("forth").alias("f"), F.col("forth_open").alias("fo"))
        behind = out.filter("forth_open").select(F.col("forth").alias("id"), F.col("back").alias("b"), F.col("back_open").alias("bo"))
        met = state.filter(~goes).join(ahead, "id", "left").join(behind, "id", "left")
        state = settled(met.select("id", F.coalesce("b", "back").alias("back"), F.coalesce("f", "forth").alias("forth"), F.coalesce("bo", "back_open").alias("back_open"), F.coalesce("fo", "forth_open").alias("forth_open")))
        taken.append(out)
        before, size = size, state.count()
        if size > 0.9 * before:  # rings of one node are left
            break
    return state, taken


def chains(links: DataFrame, told: Callable[[str], None] | None = None) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """The nodes with one way in and one way out (``id``), those of them that ``thinned`` took out, round by round, and the others.

    Of the others, ``back`` and ``forth`` are the nodes at the ends of their chain,
    ``first`` tells the chain's first node, and of nodes on a ``ring`` of their own,
    which has no ends, ``most`` is its largest.  Pointers jump to the pointers of
    where they lead, so a chain of n nodes takes about log2 n rounds.
    """
    none = F.lit(None).cast(links.schema["source_id"].dataType)
    ends = F.array(F.struct(F.col("source_id").alias("id"), none.alias("back"), F.col("target_id").alias("forth")), F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("back"), none.alias("forth")))
    ways = links.select(F.explode(ends).alias("e")).select("e.*").groupBy("id").agg(*[f(c).alias(f"{n}_{c}") for c in ("back", "forth") for n, f in (("lo", F.min), ("hi", F.max))])
    inner = settled(ways.filter("lo_back = hi_back AND lo_forth = hi_forth").select("id", F.col("lo_back").alias("back"), F.col("lo_forth").alias("forth")))
    here = inner.select("id", F.lit(True).alias("open"))
    side = lambda c: here.select(F.col("id").alias(c), F.col("open").alias(f"{c}_open"))
    state = inner.join(side("forth"), "forth", "left").join(side("back"), "back", "left")
    state = settled(state.select("id", "back", "forth", F.coalesce("back_open", F.lit(False)).alias("back_open"), F.coalesce("forth_open", F.lit(False)).alias("forth_open")))
    state, taken = thinned(state, told)
    size = state.count()
    state = state.withColumns({"first": ~F.col("back_open"), "most": F.col("id")})
    for _ in range(max(size - 1, 0).bit_length()):
        if state.filter("back_open OR forth_open").limit(1).count() == 0:
            break
        if told:
            told("jump")
        ahead = state.select(F.col("id").alias("forth"), F.col("forth").alias("f"), F.col("forth_open").alias("fo"), F.col("most").alias("m"))
        behind = state.select(F.col("id").alias("back"), F.col("back").alias("b"), F.col("back_open").alias("bo"))
        jumped = state.join(ahead, "forth", "left").join(behind, "back", "left")
        state = settled(
            jumped.select(
                "id",
                F.when(F.col("back_open"), F.col("b")).otherwise(F.col("back")).alias("back"),
                F.when(F.col("forth_open"), F.col("f")).otherwise(F.col("forth")).alias("forth"),
                (F.col("back_open") & F.col("bo")).alias("back_open"),
                (F.col("forth_open") & F.col("fo")).alias("forth_open"),
                "first",
                F.when(F.col("forth_open"), F.greatest("most", "m")).otherwise(F.col("most")).alias("most"),
            )
        )
    return inner.select("id"), taken, state.select("id", "back", "forth", "first", (F.col("back_open") & F.col("forth_open")).alias("ring"), "most")


def _renamed(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links with their ends under new names (``id``, ``to``), loops and repetitions dropped; others keep theirs."""
    out = links.join(names.select(F.col("id").alias("source_id"), F.col("to").alias("s")), "source_id", "left").join(names.select(F.col("id").alias("target_id"), F.col("to").alias("t")), "target_id", "left")
    return out.select(F.coalesce("s", "source_id").alias("source_id"), F.coalesce("t", "target_id").alias("target_id")).filter("source_id <> target_id").distinct()


def _reached(links: DataFrame, rounds: int, turn: int, told: Callable[[str], None]) -> tuple[DataFrame, bool]:
    """``id``, ``ahead``, ``behind``: of the nodes that reach it, and that it reaches, in ``rounds`` steps the one of highest rank; and whether more steps change nothing."""
    ids = links.select(F.col("source_id").alias("id")).unionByName(links.select(F.col("target_id").alias("id"))).distinct()
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("id"))
    state = settled(ids.select("id", rank("id").alias("ahead"), rank("id").alias("behind")))
    for _ in range(rounds):
        told("reach")
        down = links.join(state.select(F.col("id").alias("source_id"), "ahead"), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.max("ahead").alias("a"))
        up = links.join(state.select(F.col("id").alias("target_id"), "behind"), "target_id").groupBy(F.col("source_id").alias("id")).agg(F.max("behind").alias("b"))
        better = state.join(down, "id", "left").join(up, "id", "left")
        new = settled(better.select("id", F.col("ahead").alias("was_a"), F.col("behind").alias("was_b"), F.greatest("ahead", F.coalesce("a", "ahead")).alias("ahead"), F.greatest("behind", F.coalesce("b", "behind")).alias("behind")))
        state = new.select("id", "ahead", "behind")
        if new.filter("ahead <> was_a OR behind <> was_b").limit(1).count() == 0:
            return state, True
    return state, False


def strong_components(edges: DataFrame, told: Callable[[str], None] | None = None) -> DataFrame:
    """``id``, ``component``: nodes on cycles, by strongly connected component (named by its largest id), nodes that link to themselves included.

    The graph shrinks by rules that keep its components.  A chain of nodes with
    one way in and one way out becomes a link between its ends, found by taking
    nodes out of it and, once few are left, by pointer doubling, whatever its
    length; it is in a component if both ends are in the same, and a ring is one.
    Nodes without a way in or out go.  Nodes that link to each other become one.
    What is left is searched forward and backward from
    all nodes at once: a node that the same node of highest rank reaches and is
    reached from within some steps becomes one with it, so that clusters all over
    the graph shrink in one search; only a search that changes nothing is made
    longer, and one that has reached all there is cuts the links between
    different results.  At last the rules are undone in reverse order.  ``told``
    is called with a name in every round.
    """
    told = told or (lambda name: None)
    loops = edges.filter("source_id = target_id").select(F.col("source_id").alias("id")).distinct()
    links = settled(edges.select("source_id", "target_id").filter("source_id IS NOT NULL AND target_id IS NOT NULL AND source_id <> target_id"))
    size, steps, length, turn = links.count(), [], 2, 0
    while size:
        before = size
        gone, taken, found = chains(links, told)
        if gone.limit(1).count():
            rings = settled(found.filter("ring AND id <> most").select("id", F.col("most").alias("to")))
            inner = settled(found.filter("NOT ring"))
            steps += [*((out.select("id", "back", "forth"), "chain") for out in taken), (rings, None), (inner, "chain")]
            short = inner.filter("first AND back <> forth").select(F.col("back").alias("source_id"), F.col("forth").alias("target_id"))
            for out in taken:
                short = short.unionByName(out.filter("NOT back_open AND NOT forth_open AND back <> forth").select(F.col("back").alias("source_id"), F.col("forth").alias("target_id")))
            outer = links.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti")
            links = settled(outer.select("source_id", "target_id").unionByName(short).distinct())
        told("trim")
        core = links.select(F.col("source_id").alias("id")).intersect(links.select(F.col("target_id").alias("id")))
        links = settled(induced(core, links).distinct())
        pairs = links.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.min("source_id").alias("lo"), F.max("source_id").alias("hi"))
        mutual = settled(pairs.filter("lo <> hi").select("a", "b"))
        if mutual.limit(1).count():
            merged = settled(linked_groups(mutual, told).filter("id <> least").select("id", F.col("least").alias("to")))
            steps.append((merged, None))
            links = settled(_renamed(links, merged))
        size = links.count()
        if not size or size < 0.9 * before:
            continue
        turn += 1
        near, whole = _reached(links, length, turn, told)
        same = settled(near.filter("ahead = behind AND ahead.id <> id").select("id", F.col("ahead.id").alias("to")))
        if same.limit(1).count():
            steps.append((same, None))
        if whole:
            ends = near.select("id", F.struct("ahead", "behind").alias("seen"))
            kept = links.join(ends.select(F.col("id").alias("source_id"), F.col("seen").alias("s")), "source_id").join(ends.select(F.col("id").alias("target_id"), F.col("seen").alias("t")), "target_id").filter("s = t")
            links = kept.select("source_id", "target_id")
        links = settled(_renamed(links, same))
        size = links.count()
        if size > 0.9 * before:
            length *= 2
    label = None
    for step, kind in reversed(steps):
        told("undo")
        if kind is None:
            own = step.select("id", "to") if label is None else step.join(label.select(F.col("id").alias("to"), "label"), "to", "left").select("id", F.coalesce("label", "to").alias("to"))
        else:
            own = step.select("id", "back", "forth")
            for end in ("back", "forth"):
                own = own if label is None else own.join(label.select(F.col("id").alias(end), F.col("label").alias(f"l_{end}")), end, "left").withColumn(end, F.coalesce(f"l_{end}", end)).select("id", "back", "forth")
            own = own.filter("back = forth").select("id", F.col("back").alias("to"))
        own = own.select("id", F.col("to").alias("label"))
        label = settled(own if label is None else label.unionByName(own))
    if label is None:
        return loops.select("id", F.col("id").alias("component"))
    every = label.unionByName(label.select(F.col("label").alias("id"), "label").distinct())
    named = every.groupBy("label").agg(F.max("id").alias("component"))
    alone = loops.join(every.select("id"), "id", "left_anti")
    return every.join(named, "label").select("id", "component").unionByName(alone.select("id", F.col("id").alias("component")))


def cycles(edges: DataFrame, kinds: tuple[str, ...] = ("import", "call")) -> DataFrame:
    """``component``, ``members``, ``size`` of the cyclic groups of a graph, self-loops included."""
    own = edges.filter(F.col("edge_type").isin(*kinds))
    groups = strong_components(own)
    counted = groups.groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("members"), F.count("*").alias("size"))
    loops = own.filter("source_id = target_id").select(F.col("source_id").alias("component")).distinct().withColumn("loop", F.lit(True))
    return counted.join(loops, "component", "left").filter("size > 1 OR loop").drop("loop")


def depth_first_cycles(links: dict[str, list[str]]) -> list[list[str]]:
    """Paths closed by back edges in a depth-first walk of a small graph, in the order of its keys and lists."""
    seen: set[str] = set()
    found = []
    for root in links:
        if root in seen:
            continue
        path, at, stack = [], {}, [(root, iter(links.get(root, [])))]
        seen.add(root)
        path.append(root)
        at[root] = 0
        while stack:
            node, rest = stack[-1]
            for to in rest:
                if to in at:
                    found.append(path[at[to] :])
                elif to not in seen and to in links:
                    seen.add(to)
                    at[to] = len(path)
                    path.append(to)
                    stack.append((to, iter(links.get(to, []))))
                    break
            else:
                stack.pop()
                path.pop()
                del at[node]
    return found


def first_or_last(df: DataFrame, key: str, order: list[str], last: bool = True) -> DataFrame:
    """One row for each key: the last (or first) in load order."""
    by = [F.desc(c) if last else F.asc(c) for c in order]
    return df.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*by))).filter("__n = 1").drop("__n")
