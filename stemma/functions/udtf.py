"""Parsers and scanners as table functions for SQL: ``FROM sources, LATERAL parse_source(file, text)``."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class ParseSource:
    def eval(self, file: str, text: str):
        from stemma.sources.python_ast import Module

        if text is None:
            return
        try:
            m = Module(file, text)
        except (SyntaxError, ValueError, RecursionError):
            return
        for n in m.nodes:
            yield "node", n["id"], n["node_type"], n["qualified_name"], None, None, n["line"]
        for e in m.edges.values():
            yield "edge", e["id"], e["edge_type"], None, e["source_id"], e["target_id"], None


class ScanSource:
    def eval(self, file: str, text: str):
        from stemma.sources.python_ast import file_findings

        for f in file_findings(file, text or ""):
            yield f["rule"], f["severity"], f["category"], f["line"], f["confidence"]


class SourceComplexity:
    def eval(self, file: str, text: str):
        from stemma.sources.python_ast import units

        for u in units(file, text or ""):
            yield u["name"], u["kind"], u["line"], u["cyclomatic"], u["cognitive"], u["max_nesting"]


class SourceSteps:
    def eval(self, file: str, text: str, function: str):
        from stemma.operators.flow import function_steps

        for s in function_steps(file, text or "", function):
            yield s["step"], s["line"], s["callee"], json.dumps(s["args"]), s["loop"], s["condition"]


def register(spark: SparkSession) -> None:
    """Makes ``parse_source``, ``scan_source``, ``source_complexity`` and ``source_steps`` known to SQL."""
    spark.udtf.register("parse_source", udtf(ParseSource, returnType="row string, id string, kind string, qualified_name string, source_id string, target_id string, line long"))
    spark.udtf.register("scan_source", udtf(ScanSource, returnType="rule string, severity string, category string, line long, confidence double"))
    spark.udtf.register("source_complexity", udtf(SourceComplexity, returnType="name string, kind string, line long, cyclomatic long, cognitive long, max_nesting long"))
    spark.udtf.register("source_steps", udtf(SourceSteps, returnType="step long, line long, callee string, args string, loop string, condition string"))
