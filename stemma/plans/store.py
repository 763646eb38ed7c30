"""A property graph stored as Parquet: node tables by label, and one table of relations.

A state of the graph is a manifest: a small numbered file that names the folders
the graph consists of.  A write makes new folders and then renames a new manifest
to the next number, which is one step: readers see the graph before or after it,
and a write that dies leaves the graph as it was.  Two writers can't take the same
number, so the later one fails.

Relations are laid out by the label of their source and a hash of it, so what
leads from bound nodes is found by reading their partitions only.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.functions.scoring import looked_up
from stemma.schema import LABELS, TABLE_OF_KIND

#: Columns of stored nodes; those that a label lacks are null in it.
STORED = [
    ("uid", "string"),
    ("label", "string"),
    ("name", "string"),
    ("filePath", "string"),
    ("startLine", "bigint"),
    ("endLine", "bigint"),
    ("docstring", "string"),
    ("source_code", "string"),
    ("health_status", "string"),
    ("health_score", "double"),
    ("cyclomatic_complexity", "bigint"),
    ("cognitive_complexity", "bigint"),
    ("maintainability_index", "double"),
    ("halstead_difficulty", "double"),
    ("lines_of_code", "bigint"),
    ("bases", "string"),
    ("signature", "string"),
    ("is_async", "boolean"),
    ("is_property", "boolean"),
    ("kind", "string"),
    ("keywords", "string"),
    ("cohesion", "double"),
    ("symbolCount", "bigint"),
    ("entryPointId", "string"),
    ("stepCount", "bigint"),
    ("processType", "string"),
]
FULL = ("Module", "Package", "Class", "Function", "Method")
NODE_SCHEMA = T.StructType([T.StructField(n, {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[t]) for n, t in STORED])
#: Relations that a partition of a label should hold, and such partitions at most.
PARTITION_ROWS, BUCKETS = 1_000_000, 1024
EDGE_SCHEMA = T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("weight", T.DoubleType())])


def bucket_of(uid: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(uid)), F.lit(max(buckets, 1))).cast("int")


def stored_nodes(nodes: DataFrame) -> DataFrame:
    """Graph nodes as stored rows: kinds that aren't stored go, missing values take their defaults."""
    have = {c.lower() for c in nodes.columns}
    label = looked_up(F.col("node_type"), TABLE_OF_KIND, "")
    given = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name.lower() in have else F.lit(default)
    full, code = F.col("label").isin(*FULL), F.col("label").isin("Function", "Method")
    placed = full | (F.col("label") == "Variable")
    value = {
        "uid": F.col("id"),
        "name": given("name", ""),
        "filePath": F.when(placed, given("file", "")),
        "startLine": F.when(placed, given("line", 0)),
        "endLine": F.when(placed, given("end_line", 0)),
        "docstring": F.when(full, given("docstring", "")),
        "source_code": F.when(full, given("source_code", "")),
        "health_status": F.when(full, given("status", "unknown")),
        "health_score": F.when(full, given("score", 1.0)),
        "cyclomatic_complexity": F.when(full, given("cyclomatic_complexity", 0)),
        "cognitive_complexity": F.when(full, given("cognitive_complexity", 0)),
        "maintainability_index": F.when(full, given("maintainability_index", 100.0)),
        "halstead_difficulty": F.when(full, given("halstead_difficulty", 0.0)),
        "lines_of_code": F.when(full, given("lines_of_code", 0)),
        "bases": F.when(F.col("label") == "Class", ""),
        "signature": F.when(code, given("signature", "")),
        "is_async": F.when(code, False),
        "is_property": F.when(F.col("label") == "Method", False),
        "kind": F.when(F.col("label") == "External", F.col("node_type")),
    }
    own = nodes.withColumn("label", label).filter("label <> ''")
    return own.select(*[(F.col("label") if n == "label" else value.get(n, F.lit(None))).cast(t).alias(n) for n, t in STORED])


def stored_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations between stored nodes, and the edges skipped because an end is not stored."""
    ids = nodes.select("uid")
    weight = F.coalesce("weight", F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    own = edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("edge_type").alias("kind"), weight.cast("double").alias("weight"))
    kept = own.join(ids.withColumnRenamed("uid", "source"), "source", "left_semi").join(ids.withColumnRenamed("uid", "target"), "target", "left_semi")
    no_source = own.join(ids.withColumnRenamed("uid", "source"), "source", "left_anti")
    no_target = own.join(ids.withColumnRenamed("uid", "source"), "source", "left_semi").join(ids.withColumnRenamed("uid", "target"), "target", "left_anti")
    return kept.select("source", "target", "kind", "weight"), no_source.unionByName(no_target)


@dataclass
class GraphStore:
    """Tables of a stored graph; on disk below ``path`` if it has one."""

    spark: SparkSession
    path: str | None = None
    _nodes: DataFrame | None = field(default=None, repr=False)
    _edges: DataFrame | None = field(default=None, repr=False)

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> GraphStore:
        """A store that isn't written."""
        own = stored_nodes(nodes)
        return cls(nodes.sparkSession, None, own, stored_edges(edges, own)[0])

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> GraphStore:
        """The store at a path, made if there is none."""
        store = cls(spark, path)
        if not store._version():
            store._write(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))
        return store

    def _folder(self, name: str):
        """A path below the store for Hadoop, and its file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _version(self) -> int:
        """The number of the latest manifest, 0 without any."""
        folder, system = self._folder("manifests")
        if not system.exists(folder):
            return 0
        return max([int(f.getPath().getName()) for f in system.listStatus(folder) if f.getPath().getName().isdigit()], default=0)

    def _manifest(self) -> dict:
        """The folders of the graph, and in how many parts relations of a label are."""
        version = self._version()
        if not version:
            return {"nodes": [], "relations": [], "buckets": 1}
        path, system = self._folder(f"manifests/{version}")
        stream = system.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict, after: int) -> None:
        """Makes a manifest the one after another, unless somebody else has written meanwhile."""
        draft, system = self._folder(f"manifests/draft-{uuid.uuid4().hex}")
        target, _ = self._folder(f"manifests/{after + 1}")
        stream = system.create(draft)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if system.exists(target) or not system.rename(draft, target):
            system.delete(draft, False)
            raise RuntimeError(f"the store at {self.path} was written by another since it was read")

    def _new(self, kind: str) -> str:
        return f"{kind}-{uuid.uuid4().hex}"

    def _put_nodes(self, rows: DataFrame) -> str:
        folder = self._new("nodes")
        rows.write.partitionBy("label").parquet(f"{self.path}/{folder}")
        return folder

    def _put_relations(self, rows: DataFrame, labels: DataFrame, buckets: int) -> str:
        """Relations with their sources' labels (``uid``, ``label``), by label and bucket, in order of their targets."""
        folder = self._new("relations")
        own = rows.join(labels.select(F.col("uid").alias("source"), F.col("label").alias("source_label")).dropDuplicates(["source"]), "source", "left")
        dealt = own.withColumn("bucket", bucket_of("source", buckets)).repartition("source_label", "bucket").sortWithinPartitions("source_label", "bucket", "target")
        dealt.select(*EDGE_SCHEMA.names, "source_label", "bucket").write.partitionBy("source_label", "bucket").parquet(f"{self.path}/{folder}")
        return folder

    def _write(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Replaces the graph; both tables are there before either is seen."""
        before = self._version()
        buckets = min(BUCKETS, max(1, -(-edges.count() // PARTITION_ROWS)))
        manifest = {"nodes": [self._put_nodes(nodes)], "relations": [self._put_relations(edges, nodes, buckets)], "buckets": buckets}
        self._commit(manifest, before)

    def _read(self, kind: str, schema: T.StructType) -> DataFrame:
        folders = self._manifest()[kind]
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{f}") for f in folders]
        out = parts[0] if parts else self.spark.createDataFrame([], schema)
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def nodes(self) -> DataFrame:
        return self._nodes if self._nodes is not None else self._read("nodes", NODE_SCHEMA).select(*[n for n, _ in STORED])

    def relations(self) -> tuple[DataFrame, int]:
        """Relations with ``source_label`` and ``bucket``, by which they are laid out, and the number of buckets."""
        if self._edges is not None:
            return self._edges.select("*", F.lit(None).cast("string").alias("source_label"), F.lit(0).alias("bucket")), 0
        schema = T.StructType([*EDGE_SCHEMA.fields, T.StructField("source_label", T.StringType()), T.StructField("bucket", T.IntegerType())])
        return self._read("relations", schema), self._manifest()["buckets"]

    def edges(self) -> DataFrame:
        return self._edges if self._edges is not None else self.relations()[0].select(*EDGE_SCHEMA.names)

    def save(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """Replaces all that is stored; returns the edges that were skipped."""
        from stemma.operators.graph import settled

        own = settled(stored_nodes(nodes.dropDuplicates(["id"])))
        kept, skipped = stored_edges(edges, own)
        self._write(own, settled(kept))
        return skipped

    def add(self, rows: DataFrame) -> None:
        """Appends stored node rows, such as communities and processes."""
        full = rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in STORED])
        before, manifest = self._version(), self._manifest()
        self._commit({**manifest, "nodes": [*manifest["nodes"], self._put_nodes(full)]}, before)

    def relate(self, rows: DataFrame) -> None:
        """Appends relations."""
        before, manifest = self._version(), self._manifest()
        folder = self._put_relations(rows.select(*EDGE_SCHEMA.names), self.nodes(), manifest["buckets"])
        self._commit({**manifest, "relations": [*manifest["relations"], folder]}, before)

    def add_communities(self, communities: DataFrame) -> None:
        self.add(communities.select(F.lit("Community").alias("label"), F.col("community_id").alias("uid"), "name", F.array_join("keywords", ", ").alias("keywords"), "cohesion", F.col("size").alias("symbolCount")))

    def add_processes(self, processes: DataFrame) -> None:
        self.add(processes.select(F.lit("Process").alias("label"), F.col("process_id").alias("uid"), "name", F.col("entry").alias("entryPointId"), F.col("step_count").alias("stepCount"), F.lit("execution_flow").alias("processType")))

    def count_nodes(self) -> int:
        return self.nodes().count()

    def label_counts(self) -> DataFrame:
        """``label``, ``n``, labels without nodes included."""
        own = self.nodes().groupBy("label").agg(F.count("*").alias("k"))
        labels = self.spark.createDataFrame([(x,) for x in LABELS], "label string")
        return labels.join(own, "label", "left").select("label", F.coalesce("k", F.lit(0)).alias("n"))

    def status_counts(self) -> DataFrame:
        return self.nodes().filter("label IN ('Function', 'Method')").groupBy("health_status").agg(F.count("*").alias("n"))

    def relation_count(self) -> int:
        return self.edges().count()

    def hotspots(self, limit: int = 10) -> DataFrame:
        return self.nodes().filter("label = 'Function' AND cyclomatic_complexity > 0").orderBy(F.desc("cyclomatic_complexity"), "uid").limit(limit)

    def unhealthy(self, below: float = 0.5) -> DataFrame:
        return self.nodes().filter(F.col("label").isin("Function", "Method") & (F.col("health_score") < below)).orderBy("health_score", "uid")

    def impact(self, name: str, direction: str = "upstream", depth: int = 3) -> DataFrame:
        """What is reached from the node that a name stands for, a join for each level."""
        from stemma.operators import graph
        from stemma.schema import LOOKUP_ORDER

        rank = F.array_position(F.array(*[F.lit(x) for x in LOOKUP_ORDER]), F.col("label"))
        start = self.nodes().filter(F.col("name") == name).withColumn("r", rank).filter("r > 0").orderBy("r", "uid").limit(1).select(F.col("uid").alias("id"))
        edges = self.edges().select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.col("kind").alias("edge_type"))
        found = graph.impact(edges, start, direction, depth)
        return found.join(self.nodes().select(F.col("uid").alias("id"), "name", "filePath"), "id")

    def query(self, text: str, parameters: dict | None = None) -> list[dict]:
        """Rows of a graph query as dicts."""
        from stemma.plans import cypher

        return [r.asDict(recursive=True) for r in cypher.run(self, text, parameters or {}).collect()]
