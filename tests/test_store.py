"""Writes of a stored graph that fail half way, and relations that are read by partition."""

import pytest
from pyspark.sql import functions as F

from stemma.plans import cypher, store

NONE = "id string, source_id string, target_id string, edge_type string, weight double"


def people(spark, n=20):
    nodes = spark.range(n).select(F.format_string("f%03d", "id").alias("id"), F.when(F.col("id") % 4 == 0, "class").otherwise("function").alias("node_type"), F.format_string("n%d", "id").alias("name"), F.format_string("m.n%d", "id").alias("qualified_name"))
    edges = spark.range(n - 1).select(F.format_string("e%d", "id").alias("id"), F.format_string("f%03d", "id").alias("source_id"), F.format_string("f%03d", F.col("id") + 1).alias("target_id"), F.lit("call").alias("edge_type"), F.lit(1.0).alias("weight"))
    return nodes, edges


def test_a_write_that_dies_between_the_tables_changes_nothing(spark, tmp_path, monkeypatch):
    own = store.GraphStore.opened(spark, str(tmp_path / "g"))
    own.save(*people(spark))

    def dies(self, rows, labels, buckets):
        raise OSError("killed")

    monkeypatch.setattr(store.GraphStore, "_put_relations", dies)
    with pytest.raises(OSError):
        own.save(*people(spark, 5))
    with pytest.raises(OSError):
        cypher.run(own, "MATCH (a:Function {name:'n1'}) DETACH DELETE a")
    monkeypatch.undo()
    again = store.GraphStore.opened(spark, str(tmp_path / "g"))
    assert (again.count_nodes(), again.relation_count()) == (20, 19)
    assert cypher.run(again, "MATCH (a:Function {name:'n1'}) DETACH DELETE a").count() == 1
    assert (again.count_nodes(), again.relation_count()) == (19, 17)


def test_of_two_writers_the_later_fails(spark, tmp_path, monkeypatch):
    own = store.GraphStore.opened(spark, str(tmp_path / "g"))
    put = store.GraphStore._put_nodes

    def meanwhile(self, rows):
        monkeypatch.undo()
        store.GraphStore.opened(spark, str(tmp_path / "g")).save(*people(spark, 6))
        return put(self, rows)

    monkeypatch.setattr(store.GraphStore, "_put_nodes", meanwhile)
    with pytest.raises(RuntimeError):
        own.save(*people(spark, 9))
    assert own.count_nodes() == 6


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bound_ends_read_their_partitions_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PARTITION_ROWS", 4)
    own = store.GraphStore.opened(spark, str(tmp_path / "g"))
    own.save(*people(spark, 60))
    assert own._manifest()["buckets"] == 15
    by_id = cypher.run(own, "MATCH (a:Function {uid:'f005'})-[r:CodeRelation]->(b) RETURN a.name, b.name")
    text = plan(by_id)
    scan = next(line for line in text.splitlines() if "FileScan" in line and "source_label" in line)
    assert "PartitionFilters: [isnotnull(source_label" in scan and "bucket" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "EqualTo(source,f005)" in scan
    assert [tuple(r) for r in by_id.collect()] == [("n5", "n6")]
    by_name = cypher.run(own, "MATCH (a:Function {name:'n5'})-[r:CodeRelation]->(b) RETURN a.name, b.name")
    lines = plan(by_name).splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "source_label" in line)
    assert "dynamic" in lines[at] and not any("Exchange hashpartitioning" in line for line in lines)
    assert [tuple(r) for r in by_name.collect()] == [("n5", "n6")]
    two = cypher.run(own, "MATCH (a:Function {name:'n5'})-[r:CodeRelation]->(b)-[s:CodeRelation]->(c) RETURN a.name, c.name")
    assert [tuple(r) for r in two.collect()] == [("n5", "n7")]
    whole = cypher.run(own, "MATCH (a:Function {name:'n5'})-[r:CodeRelation]->(b) RETURN a, r").first()
    assert set(whole["a"].asDict()) == {n for n, _ in store.STORED} and set(whole["r"].asDict()) == {"source", "target", "kind", "weight"}
    assert cypher.run(own, "MATCH (a)-[r]->(a) RETURN count(*) AS n").first()["n"] == 0
