"""Relational tables as the engine's data model, for graphs that weren't parsed from source.

Places, people, orders and parts stand for packages, modules, classes, methods
and functions; their foreign keys for edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.functions.scoring import edge_id, maintainability, node_id

#: kind, table, key column, name column
ENTITIES = [
    ("package", "region", "r_regionkey", "r_name"),
    ("module", "nation", "n_nationkey", "n_name"),
    ("class", "customer", "c_custkey", "c_name"),
    ("class", "supplier", "s_suppkey", "s_name"),
    ("method", "orders", "o_orderkey", "o_orderpriority"),
    ("function", "part", "p_partkey", "p_name"),
]


#: Source files that a task parses, and orders or order lines that it makes edges of.
FILES, LINES = 2_000, 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _qualified(name: str, key: str):
    return F.concat(F.lit(f"{name}."), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id``, ``node_type``, ``name``, ``qualified_name``."""
    own = []
    for kind, name, key, title in ENTITIES:
        qualified = _qualified(name, key)
        own.append(table(spark, sf_dir, name).select(node_id(F.lit(kind), qualified).alias("id"), F.lit(kind).alias("node_type"), F.col(title).alias("name"), qualified.alias("qualified_name")))
    return reduce(DataFrame.unionByName, own)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id``, ``source_id``, ``target_id``, ``edge_type``, ``weight``."""
    kind_of = {name: kind for kind, name, _, _ in ENTITIES}

    def relation(rows: DataFrame, source: str, source_key: str, target: str, target_key: str, kind: str) -> DataFrame:
        return rows.select(node_id(F.lit(kind_of[source]), _qualified(source, source_key)).alias("source_id"), node_id(F.lit(kind_of[target]), _qualified(target, target_key)).alias("target_id"), F.lit(kind).alias("edge_type"))

    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")

    def dealt(rows: DataFrame, count: int, *keys: str) -> DataFrame:
        """Keys of rows, LINES to a task: what is summed or sorted there grows with a task's rows, and splits of files and joined partitions grow with the table."""
        return rows.select(*keys).repartition(-(-count // LINES) or 1, *keys)

    of_orders, of_lines = orders.count(), lines.count()
    own = [
        relation(table(spark, sf_dir, "nation"), "nation", "n_nationkey", "region", "n_regionkey", "import"),
        relation(table(spark, sf_dir, "customer"), "customer", "c_custkey", "nation", "c_nationkey", "reference"),
        relation(table(spark, sf_dir, "supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "reference"),
        relation(dealt(orders, of_orders, "o_custkey", "o_orderkey"), "customer", "o_custkey", "orders", "o_orderkey", "call"),
        relation(dealt(lines, of_lines, "l_orderkey", "l_partkey").distinct(), "orders", "l_orderkey", "part", "l_partkey", "call"),
        relation(dealt(lines, of_lines, "l_partkey", "l_suppkey").distinct(), "part", "l_partkey", "supplier", "l_suppkey", "call"),
    ]
    every = reduce(DataFrame.unionByName, own)
    return every.select(edge_id(F.col("edge_type"), F.col("source_id"), F.col("target_id")).alias("id"), "source_id", "target_id", "edge_type", F.lit(1.0).alias("weight"))


def part_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each part from its order lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey")
    own = lines.agg(
        F.count_if(F.col("l_discount") > 0.06).alias("cyclomatic"),
        F.count_if(F.col("l_tax") > 0.05).alias("cognitive"),
        F.max("l_linenumber").cast("long").alias("depth"),
        F.avg("l_quantity").alias("difficulty"),
        F.sum("l_quantity").alias("volume"),
        F.count("*").alias("loc"),
    )
    return own.withColumn("maintainability", maintainability(F.col("volume"), F.col("cyclomatic"), F.col("loc")))


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_id``, ``target_id``, ``n``: nations whose customers order, from nations' suppliers."""
    customers, suppliers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("c_nationkey").cast("long").alias("source_id"), F.col("s_nationkey").cast("long").alias("target_id")).agg(F.count("*").alias("n"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as trace frames: a session for each user, times from its first event."""
    by_user = W.partitionBy("user_id")
    rows = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    role = F.when(F.col("event_type") == "click", "call").when(F.col("event_type") == "view", "return").when(F.col("event_type") == "error", "exception").otherwise(F.col("event_type"))
    return rows.select(
        F.col("user_id").alias("session_id"),
        "event_id",
        (F.row_number().over(by_user.orderBy("ts", "event_id")) - 1).cast("long").alias("frame_index"),
        role.alias("event_type"),
        F.pmod("event_id", F.lit(97)).alias("node_id"),
        ((F.col("t") - F.min("t").over(by_user)) * 1000).alias("elapsed_ns"),
        "value",
    )


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and sizes of parts, FILES to a task: the table is small, what is made of its rows and parsed is not."""
    own = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return own.repartition(-(-own.count() // FILES) or 1, "p_partkey")


def python_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(``file``, ``text``): a Python file for each part, with as many decisions as its size modulo 5."""
    key, decisions = F.col("p_partkey").cast("string"), (F.col("p_size") % 5).cast("int")
    text = F.concat(
        F.lit("import os\n\n\nclass P"), key, F.lit(":\n    size = "), F.col("p_size").cast("string"), F.lit("\n\n    def price(self, x):\n"),
        F.repeat(F.lit("        if x > 1:\n            x = x - 1\n"), decisions),
        F.lit("        return help"), key, F.lit("(x)\n\n\ndef help"), key, F.lit("(x):\n    y = os.getcwd()\n    return y\n\n\ndef main(x):\n    y = load"), key, F.lit("(x)\n    z = save(y)\n    return z\n"),
    )
    return _parts(spark, sf_dir).select(F.concat(F.lit("d/p"), key, F.lit(".py")).alias("file"), text.alias("text"))


def script_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(``file``, ``text``): a JavaScript file for each part."""
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("function load"), key, F.lit("(x) {\n  return x;\n}\n\nclass P"), key, F.lit(" {\n  price(x) {\n    return load"), key, F.lit("(x);\n  }\n}\n"))
    return _parts(spark, sf_dir).select(F.concat(F.lit("d/q"), key, F.lit(".js")).alias("file"), text.alias("text"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id``, ``target``: distinct links in pages' markup."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target")).distinct()


def customer_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path``: region/nation/segment/customer."""
    customer, nation, region = (table(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.concat_ws("/", "r_name", "n_name", "c_mktsegment", "c_name").alias("path"), "c_custkey")
