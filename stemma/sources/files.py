"""Source files, saved graphs and recordings from storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.functions.names import language_of, suffix
from stemma.schema import EDGES, NODES

#: The language that decides what is read of a folder: the first that occurs.
DETECTED = [".js", ".ts", ".tsx", ".java", ".go", ".rs", ".c", ".cpp"]


def directory(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(``file``, ``text``) of all files below a folder that a parser knows and that match a name pattern; Spark's reader leaves out empty files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("file"), F.decode("content", "UTF-8").alias("text"))
    return rows.filter(language_of(F.col("file")).isNotNull())


def text(spark: SparkSession, source: str, filename: str = "<string>.py") -> DataFrame:
    return spark.createDataFrame([(filename, source)], "file string, text string")


def detected_pattern(files: DataFrame) -> str:
    """``*`` and the first known suffix that occurs, Python's if there's none."""
    found = {r["s"] for r in files.select(suffix(F.col("file")).alias("s")).distinct().filter(F.col("s").isin(DETECTED)).collect()}
    return next((f"*{s}" for s in DETECTED if s in found), "*.py")


def saved_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of an exported graph; of the metrics complexity, lines and depth come back."""
    node = "struct<id:string,name:string,node_type:string,qualified_name:string,parent_id:string,docstring:string,signature:string,position:struct<file:string,line:bigint,column:bigint,end_line:bigint>,metrics:struct<cyclomatic_complexity:bigint,lines_of_code:bigint,depth:bigint>,health:string>"
    edge = "struct<id:string,source_id:string,target_id:string,edge_type:string,weight:double>"
    raw = spark.read.option("multiLine", True).schema(f"name string, nodes map<string,{node}>, edges map<string,{edge}>").json(path)
    nodes = raw.select(F.explode(F.map_values("nodes")).alias("n")).select("n.id", "n.name", "n.node_type", "n.qualified_name", "n.parent_id", "n.docstring", "n.signature", "n.position.file", "n.position.line", "n.position.column", "n.position.end_line", "n.metrics.cyclomatic_complexity", "n.metrics.lines_of_code", "n.metrics.depth", F.col("n.health").alias("status"))
    return nodes, raw.select(F.explode(F.map_values("edges")).alias("e")).select("e.*")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as JSON lines of nodes and edges, in two folders."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What ``save_graph`` wrote."""
    judged = T.StructType([*NODES.fields, T.StructField("score", T.DoubleType()), T.StructField("status", T.StringType())])
    return spark.read.schema(judged).json(f"{path}/nodes"), spark.read.schema(EDGES).json(f"{path}/edges")


def graph_document(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """One row ``json``: a small graph as one document, nodes and edges keyed by id, modules as roots."""
    position = F.struct("file", "line", "column", "end_line").alias("position")
    metrics = F.struct("cyclomatic_complexity", "lines_of_code", "depth").alias("metrics")
    own = nodes.agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("id", "name", "node_type", "qualified_name", "parent_id", "docstring", "signature", position, metrics, F.col("status").alias("health"))))).alias("nodes"), F.collect_list(F.when(F.col("node_type") == "module", F.col("id"))).alias("root_ids"))
    links = edges.agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("id", "source_id", "target_id", "edge_type", "weight")))).alias("edges"))
    return own.join(F.broadcast(links)).select(F.to_json(F.struct(F.lit(name).alias("name"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "nodes", "edges", "root_ids")).alias("json"))  # one row each


FRAME = "timestamp string, frame_index bigint, node_id string, event_type string, event_data map<string,string>, local_vars map<string,string>, call_stack array<string>, elapsed_ns bigint"
#: What a frame of a recording consists of.
FRAME_FIELDS = ["timestamp", "frame_index", "node_id", "event_type", "event_data", "local_vars", "call_stack", "elapsed_ns"]
#: Frames of a range, which is a folder of its own, and of a file at most.
RANGE, FILE_ROWS = 250_000, 50_000


def _in_ranges(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a recording in ranges of frames."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder) or not system.getFileStatus(folder).isDirectory():
        return False
    return any(f.getPath().getName().startswith("frame_range=") for f in system.listStatus(folder))


def recording(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Frames of a saved recording (JSON, gzip or not), all or from ``first`` to ``last``.

    A recording in ranges is read by many tasks, and only in the ranges asked
    for; one that is a document is one task's work.
    """
    if _in_ranges(spark, path):
        rows = spark.read.schema(f"session_id string, {FRAME}, frame_range int").json(path)
        if first is not None:
            rows = rows.filter((F.col("frame_range") >= first // RANGE) & (F.col("frame_index") >= first))
        if last is not None:
            rows = rows.filter((F.col("frame_range") <= last // RANGE) & (F.col("frame_index") <= last))
        rows = rows.drop("frame_range")
    else:
        raw = spark.read.option("multiLine", True).schema(f"session_id string, frames array<struct<{FRAME}>>").json(path)
        rows = raw.select("session_id", F.explode("frames").alias("f")).select("session_id", "f.*")
        if first is not None:
            rows = rows.filter(F.col("frame_index") >= first)
        if last is not None:
            rows = rows.filter(F.col("frame_index") <= last)
    return rows.withColumn("timestamp", F.to_timestamp("timestamp"))


def _as_saved(frames: DataFrame) -> list:
    return [F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) if c == "timestamp" else F.col(c) for c in FRAME_FIELDS if c in frames.columns]


def save_recording(frames: DataFrame, path: str, compressed: bool = True) -> None:
    """Sessions' frames as JSON lines with all fields of a frame that there are, gzip if asked, in a folder for each range of frames.

    A row is a frame and a file FILE_ROWS frames at most, in order, whatever a
    session's length; ``save_document`` writes the form of one document a session.
    """
    own = frames.select("session_id", *_as_saved(frames)).withColumn("frame_range", F.floor(F.col("frame_index") / RANGE).cast("int"))
    tasks = F.floor(F.col("frame_index") / FILE_ROWS)
    dealt = own.withColumn("__task", tasks).repartition("session_id", "__task").drop("__task").sortWithinPartitions("frame_range", "session_id", "frame_index")
    writer = dealt.write.mode("overwrite").partitionBy("frame_range").option("maxRecordsPerFile", FILE_ROWS)
    (writer.option("compression", "gzip") if compressed else writer).json(path)


def save_document(frames: DataFrame, path: str, compressed: bool = True) -> None:
    """Each session's frames as one JSON document, for sessions that fit a row."""
    rows = frames.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("frame_index", F.struct(*_as_saved(frames)).alias("f"))), lambda a, b: a["frame_index"].cast("int") - b["frame_index"].cast("int")).alias("sorted"))
    rows = rows.select("session_id", F.transform("sorted", lambda x: x["f"]).alias("frames"))
    writer = rows.write.mode("overwrite").option("maxRecordsPerFile", 1)  # a document is a file
    (writer.option("compression", "gzip") if compressed else writer).json(path)
