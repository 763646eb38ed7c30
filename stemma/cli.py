"""Commands over source folders and stored graphs: data as JSON on stdout, messages on stderr.

    analyze PATH           nodes, edges and statistics
    health PATH            score, status and notes of every entity
    index PATH [--db DIR]  stores the graph with communities and call paths
    query DB (--cypher Q | --hotspots | --unhealthy | --stats)
    impact PATH NAME       what is reached from an entity of a folder
    impact-graph DB NAME   the same from a stored graph
    communities PATH, processes PATH, complexity PATH, findings PATH
    steps FILE FUNCTION [--format json|mermaid|dot]
    report PATH            statistics and the first entities that need attention, as text
    export PATH --out DIR  the graph as JSON lines
    record PROGRAM FILES --out DIR   runs a program and writes its frames
    frames DIR             sessions of recorded frames and each frame's place, as a replay shows them
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.schema import STATUSES

DB = ".stemma_graph"


def session() -> SparkSession:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH")]))
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def rows(df: DataFrame) -> list:
    return [json.loads(x) for x in df.toJSON().collect()]


def graph_of(spark: SparkSession, path: str, pattern: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Judged nodes, resolved edges, and the sources of a file or folder."""
    from stemma.functions import scoring
    from stemma.operators import graph, resolve
    from stemma.sources import files, python_ast

    sources = files.directory(spark, path, pattern)
    parsed = graph.settled(python_ast.parsed(sources))  # parsed once for nodes and edges
    nodes, edges = resolve.resolve_calls(python_ast.nodes_of(parsed), python_ast.edges_of(parsed))
    none = F.lit(None).cast("double")
    score = scoring.health_score(F.col("cyclomatic_complexity"), none, F.col("depth"), none, none)
    return graph.settled(graph.with_health(nodes, edges, score)), graph.settled(edges), sources


def _analyze(spark, a) -> object:
    from stemma.operators import graph

    nodes, edges, _ = graph_of(spark, a.path, a.pattern)
    return {
        "nodes": rows(nodes.select("id", "name", "node_type", "qualified_name", "file", "line", "cyclomatic_complexity", "lines_of_code", "status")),
        "edges": rows(edges.select("id", "source_id", "target_id", "edge_type", "weight")),
        "stats": {**rows(graph.statistics(nodes))[0], "cycles": graph.cycles(edges).count()},
    }


def _health(spark, a) -> object:
    nodes, _, _ = graph_of(spark, a.path, a.pattern)
    return rows(nodes.select("id", "name", "node_type", "file", "line", "score", "status", "notes"))


def _index(spark, a) -> object:
    from stemma.operators import communities, paths
    from stemma.plans.store import GraphStore

    nodes, edges, _ = graph_of(spark, a.path, a.pattern)
    store = GraphStore.opened(spark, a.db or os.path.join(a.path if os.path.isdir(a.path) else os.path.dirname(a.path), DB))
    skipped = store.save(nodes, edges).count()
    indexed = store.count_nodes()
    found, ways = communities.communities(nodes, edges), paths.processes(nodes, edges)
    store.add_communities(found)
    store.add_processes(ways)
    print(f"{skipped} edges skipped", file=sys.stderr)
    return {"db": store.path, "nodes_indexed": indexed, "edges_indexed": store.relation_count(), "communities": found.count(), "processes": ways.count()}


def _query(spark, a) -> object:
    from stemma.plans.store import GraphStore

    store = GraphStore.opened(spark, a.db)
    if a.cypher:
        return store.query(a.cypher)
    if a.unhealthy:
        return rows(store.unhealthy())
    if a.hotspots:
        return rows(store.hotspots(a.limit))
    if a.stats:
        return {"labels": {r["label"]: r["n"] for r in store.label_counts().collect()}, "relations": store.relation_count(), "health": {r["health_status"]: r["n"] for r in store.status_counts().collect()}}
    raise SystemExit("one of --cypher, --unhealthy, --hotspots and --stats is needed")


def _by_level(found: DataFrame, depth: int) -> dict:
    out = {f"depth_{d}": [] for d in range(1, depth + 1)}
    for r in rows(found):
        out[f"depth_{r.pop('depth')}"].append(r)
    return out


def _impact(spark, a) -> object:
    from stemma.operators import graph

    nodes, edges, _ = graph_of(spark, a.path, a.pattern)
    found = graph.impact(edges, graph.found_by_name(nodes, a.name), a.direction, a.depth)
    return _by_level(found.join(nodes.select("id", "name", "file"), "id"), a.depth)


def _impact_graph(spark, a) -> object:
    from stemma.plans.store import GraphStore

    return _by_level(GraphStore.opened(spark, a.db).impact(a.name, a.direction, a.depth), a.depth)


def _communities(spark, a) -> object:
    from stemma.operators import communities

    nodes, edges, _ = graph_of(spark, a.path, a.pattern)
    return rows(communities.communities(nodes, edges))


def _processes(spark, a) -> object:
    from stemma.operators import paths

    nodes, edges, _ = graph_of(spark, a.path, a.pattern)
    return rows(paths.processes(nodes, edges))


def _complexity(spark, a) -> object:
    from stemma.sources import files, python_ast

    units = python_ast.complexity(files.directory(spark, a.path, a.pattern))
    summary = units.agg(F.count("*").alias("units"), F.avg("cyclomatic").alias("avg_cyclomatic"), F.max("cyclomatic").alias("max_cyclomatic"), F.avg("cognitive").alias("avg_cognitive"), F.avg("maintainability").alias("avg_maintainability"))
    return {"summary": rows(summary)[0], "hotspots": rows(units.filter("cyclomatic > 10").orderBy(F.desc("cyclomatic"), "file", "line").limit(10))}


def _findings(spark, a) -> object:
    from stemma.operators import findings
    from stemma.sources import files, python_ast

    found = python_ast.findings(files.directory(spark, a.path, a.pattern)).persist()
    suspicious = found.filter("confidence IS NOT NULL")
    return {"corpus": rows(findings.corpus_risk(findings.file_risk(suspicious)))[0], "severities": rows(findings.severity_counts(found)), "findings": rows(found)}


def _steps(spark, a) -> object:
    from stemma.operators import flow
    from stemma.sources import files

    own = flow.steps(files.directory(spark, a.path, a.pattern), a.function)
    if a.format == "json":
        return {"steps": rows(own.orderBy("file", "step")), "dependencies": rows(flow.dependency_graph(own))}
    print((flow.mermaid if a.format == "mermaid" else flow.dot)(own, flow.dependency_graph(own)))
    return None


def _report(spark, a) -> None:
    from stemma.operators import graph

    nodes, edges, _ = graph_of(spark, a.path, a.pattern)
    own = rows(graph.statistics(nodes))[0]
    total = max(1, own["total_nodes"])
    print(f"{own['total_nodes']} nodes, {edges.count()} edges, {own['total_lines']} lines, {graph.cycles(edges).count()} nodes in cycles")
    print(f"complexity {own['avg_complexity']:.2f} on average, {own['max_complexity']} at most, {own['n_hotspots']} hotspots")
    print(", ".join(f"{s} {100 * own[f'n_{s}'] / total:.1f} %" for s in STATUSES))
    for r in graph.attention(nodes).collect():
        print(f"{r['status']:<10} {r['node_type']:<9} {r['qualified_name']}: {'; '.join(r['notes'] or [])}")


def _export(spark, a) -> object:
    from stemma.sources import files

    nodes, edges, _ = graph_of(spark, a.path, a.pattern)
    files.save_graph(nodes, edges, a.out)
    return {"out": a.out, "nodes": nodes.count(), "edges": edges.count()}


def _record(_spark, a) -> object:
    import runpy

    from stemma.streaming.record import Recorder

    with Recorder(a.out, [a.path, *a.files]) as own:
        runpy.run_path(a.path, run_name="__main__")
    return {"session": own.session_id, "frames": own.count, "calls": own.calls, "exceptions": own.exceptions}


def _frames(spark, a) -> object:
    from stemma.operators import timeline
    from stemma.streaming.record import recorded

    own = recorded(spark, a.path)
    shown = timeline.frame_labels(timeline.delays(own, a.speed)).select("session_id", "frame_index", "label", timeline.clock(F.col("elapsed_ns")).alias("at"), "event_type", "qualified_name", "delay_ns")
    return {"sessions": rows(timeline.interval_statistics(own)), "frames": rows(shown.orderBy("session_id", "frame_index"))}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stemma", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *names):
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(n)
        if "path" in names:
            c.add_argument("--pattern")
        c.set_defaults(run=run)
        return c

    for name, run in (("analyze", _analyze), ("health", _health), ("communities", _communities), ("processes", _processes), ("complexity", _complexity), ("findings", _findings)):
        command(name, run, "path")
    command("index", _index, "path").add_argument("--db")
    q = command("query", _query, "db")
    q.add_argument("--cypher")
    q.add_argument("--limit", type=int, default=10)
    for flag in ("--hotspots", "--unhealthy", "--stats"):
        q.add_argument(flag, action="store_true")
    for name, run, where, direction in (("impact", _impact, "path", "downstream"), ("impact-graph", _impact_graph, "db", "upstream")):
        c = command(name, run, where, "name")
        c.add_argument("--direction", choices=["upstream", "downstream"], default=direction)
        c.add_argument("--depth", type=int, default=3)
    command("report", _report, "path")
    command("export", _export, "path").add_argument("--out", required=True)
    c = command("record", _record, "path")
    c.add_argument("files", nargs="*")
    c.add_argument("--out", required=True)
    command("frames", _frames, "path").add_argument("--speed", type=float, default=1.0)
    command("steps", _steps, "path", "function").add_argument("--format", choices=["json", "mermaid", "dot"], default="json")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if getattr(a, "path", None) and not os.path.exists(a.path):
        print(f"no such path: {a.path}", file=sys.stderr)
        return 1
    result = a.run(session(), a)
    if result is not None:
        json.dump(result, sys.stdout, default=str)
        print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
