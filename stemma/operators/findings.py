"""Findings in source text: patterns, line rules, and their roll-ups.

Rules that need a syntax tree are in ``stemma.sources.python_ast``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions.names import lines_of
from stemma.functions.scoring import malware_risk
from stemma.schema import IMPORT_SIGNATURES, SEVERITY_WEIGHTS, TEXT_PATTERNS

LONG_FILE = 500
TODO = r"(?i)\b(TODO|FIXME|XXX|HACK)\b"
PRINT = r"^\s*print\s*\("


def pattern_hits(sources: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``hits``: for each file the count of matches of each text pattern, in the order of the patterns."""
    return sources.withColumn("hits", F.array(*[F.regexp_count(F.col(text), F.lit(e)).cast("long") for _, e, _, _ in TEXT_PATTERNS]))


def pattern_totals(sources: DataFrame, text: str = "text") -> DataFrame:
    """``pattern``, ``severity``, ``category``, ``files``, ``matches`` over all patterns, those without hits included."""
    counted = pattern_hits(sources, text).agg(*[F.sum(F.get("hits", F.lit(i))).alias(f"m{i}") for i in range(len(TEXT_PATTERNS))], *[F.count_if(F.get("hits", F.lit(i)) > 0).alias(f"f{i}") for i in range(len(TEXT_PATTERNS))])
    rows = F.array(*[F.struct(F.lit(n).cast("long").alias("pattern"), F.lit(s).alias("severity"), F.lit(c).alias("category"), F.col(f"f{i}").alias("files"), F.coalesce(f"m{i}", F.lit(0)).alias("matches")) for i, (n, _, s, c) in enumerate(TEXT_PATTERNS)])
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def text_risk(sources: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``risk`` and ``likely`` of each file from its text patterns, each match of confidence 0.5."""
    weighted = reduce(lambda a, b: a + b, [F.get("hits", F.lit(i)) * (SEVERITY_WEIGHTS[s] * 0.5) for i, (_, _, s, _) in enumerate(TEXT_PATTERNS)])
    critical = reduce(lambda a, b: a | b, [F.get("hits", F.lit(i)) > 0 for i, (_, _, s, _) in enumerate(TEXT_PATTERNS) if s == "critical"])
    return pattern_hits(sources, text).select(key, malware_risk(weighted).alias("risk"), ((malware_risk(weighted) >= 0.5) | critical).alias("likely"))


def line_findings(sources: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """``rule``, ``line`` of to-do comments and leading print calls."""
    lines = sources.select(key, F.posexplode(lines_of(F.col(text))).alias("n", "content"))
    rules = F.filter(F.array(F.when(F.col("content").rlike(TODO), "todo_comment"), F.when(F.col("content").rlike(PRINT), "print_statement")), lambda r: r.isNotNull())
    return lines.select(key, (F.col("n") + 1).cast("long").alias("line"), F.explode(rules).alias("rule"))


def long_files(sources: DataFrame, key: str = "file", text: str = "text", over: int = LONG_FILE) -> DataFrame:
    return sources.select(key, F.size(lines_of(F.col(text))).cast("long").alias("n_lines")).filter(F.col("n_lines") > over)


def import_findings(imports: DataFrame, name: str = "name") -> DataFrame:
    """Imports that equal a signature (confidence 0.7) or are above or below one (0.6).

    An import meets a signature only if they share their first component, so
    this is an equi-join on it and not a comparison of all with all.
    """
    spark = imports.sparkSession
    signatures = spark.createDataFrame(list(IMPORT_SIGNATURES.items()), "signature string, severity string")
    first = lambda c: F.element_at(F.split(c, "\\."), 1)
    joined = imports.withColumn("__k", first(F.col(name))).join(F.broadcast(signatures.withColumn("__k", first(F.col("signature")))), "__k")  # as many rows as there are signatures
    exact = F.when(F.col(name) == F.col("signature"), 0.7)
    related = F.when(F.col(name).startswith(F.concat(F.col("signature"), F.lit("."))) | F.col("signature").startswith(F.concat(F.col(name), F.lit("."))), 0.6)
    return joined.withColumn("confidence", F.coalesce(exact, related)).filter("confidence IS NOT NULL").drop("__k")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def file_risk(findings: DataFrame, key: str = "file") -> DataFrame:
    """``risk`` and ``likely`` of each file from findings with severity and confidence."""
    weight = reduce(lambda a, kv: F.when(F.col("severity") == kv[0], kv[1]).otherwise(a), SEVERITY_WEIGHTS.items(), F.lit(0.0))
    rated = findings.groupBy(key).agg(malware_risk(F.sum(weight * F.col("confidence"))).alias("risk"), F.bool_or(F.col("severity") == "critical").alias("critical"), F.count("*").alias("markers"))
    return rated.withColumn("likely", (F.col("risk") >= 0.5) | F.col("critical")).drop("critical")


def corpus_risk(risks: DataFrame) -> DataFrame:
    """One row: the highest risk, whether any file is likely malicious, and all markers."""
    return risks.agg(F.coalesce(F.max("risk"), F.lit(0.0)).alias("max_risk"), F.coalesce(F.bool_or("likely"), F.lit(False)).alias("any_likely"), F.coalesce(F.sum("markers"), F.lit(0)).alias("markers"))
