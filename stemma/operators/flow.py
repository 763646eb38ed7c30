"""Execution steps of functions, their data dependencies, and text graphs of them."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.schema import TRIVIAL_CALLS

STEPS = "file string, function string, step long, line long, callee string, full_callee string, outputs array<string>, args array<string>, kwargs map<string,string>, loop string, condition string, label string"
LABEL_LINES = 6

#: Characters of a variable that the index of inputs goes by.
GRAM = 5


def step_label(lines: list[str], line: int) -> str | None:
    """The nearest comment with dashes in the lines above."""
    for above in reversed(lines[max(0, line - 1 - LABEL_LINES) : line - 1]):
        text = above.strip()
        if text.startswith("#") and "---" in text and (clean := text.lstrip("#").strip().strip("-").strip()):
            return clean
    return None


def _called(func: ast.expr) -> str:
    return getattr(func, "id", None) or getattr(func, "attr", None) or ast.unparse(func)


def _of_value(value: ast.expr | None) -> list[ast.Call]:
    """The calls that an assigned value stands for."""
    match value:
        case ast.Call():
            return [value]
        case ast.ListComp() | ast.DictComp():
            return [n for n in ast.walk(value) if isinstance(n, ast.Call)]
        case ast.Dict(values=items) | ast.Tuple(elts=items) | ast.List(elts=items):
            return [i for i in items if isinstance(i, ast.Call)]
        case None:
            return []
    return [n for n in ast.walk(value) if isinstance(n, ast.Call)][:1]


def function_steps(path: str, text: str, name: str) -> list[dict]:
    """Steps of the first function of a name, in source order; calls in arguments come before the call they feed."""
    try:
        tree = ast.parse(text, path)
    except (SyntaxError, ValueError):
        return []
    target = next((n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == name), None)
    if target is None:
        return []
    lines, out = text.splitlines(), []

    def emit(call: ast.Call, outputs: list[str], line: int, loops, conditions) -> None:
        if _called(call.func) in TRIVIAL_CALLS:
            return
        out.append(
            {
                "file": path,
                "function": name,
                "step": len(out) + 1,
                "line": line,
                "callee": _called(call.func),
                "full_callee": ast.unparse(call.func),
                "outputs": outputs,
                "args": [ast.unparse(a) for a in call.args],
                "kwargs": {k.arg: ast.unparse(k.value) for k in call.keywords if k.arg},
                "loop": " > ".join(loops) or None,
                "condition": " > ".join(conditions) or None,
                "label": step_label(lines, line),
            }
        )

    def record(call: ast.Call, outputs: list[str], line: int, loops, conditions) -> None:
        for k in call.keywords:
            if isinstance(k.value, ast.Call):
                emit(k.value, [f"({k.arg})"], k.value.lineno, loops, conditions)
        for a in call.args:
            if isinstance(a, ast.Call):
                emit(a, [], a.lineno, loops, conditions)
        emit(call, outputs, line, loops, conditions)

    def walk(body: list[ast.stmt], loops: tuple, conditions: tuple) -> None:
        for s in body:
            match s:
                case ast.Assign(targets=targets, value=value):
                    for c in _of_value(value):
                        record(c, [ast.unparse(t) for t in targets], s.lineno, loops, conditions)
                case ast.AnnAssign(target=t, value=value):
                    for c in _of_value(value):
                        record(c, [ast.unparse(t)], s.lineno, loops, conditions)
                case ast.AugAssign(target=t, value=ast.Call() as call):
                    record(call, [ast.unparse(t)], s.lineno, loops, conditions)
                case ast.Expr(value=ast.Call() as call):
                    record(call, [], s.lineno, loops, conditions)
                case ast.For():
                    walk(s.body, (*loops, f"for {ast.unparse(s.target)} in {ast.unparse(s.iter)}"), conditions)
                    walk(s.orelse, loops, conditions)
                case ast.If():
                    test = ast.unparse(s.test)
                    walk(s.body, loops, (*conditions, test))
                    chained_if = len(s.orelse) == 1 and isinstance(s.orelse[0], ast.If)
                    walk(s.orelse, loops, conditions if chained_if else (*conditions, f"else (not {test})"))
                case ast.With() | ast.AsyncWith():
                    walk(s.body, loops, conditions)
                case ast.Try():
                    for part in (s.body, *[h.body for h in s.handlers], s.finalbody, s.orelse):
                        walk(part, loops, conditions)

    walk(target.body, (), ())
    return out


def steps(sources: DataFrame, function: str) -> DataFrame:
    """Steps of a function in every file that has it."""
    columns = [c.split()[0] for c in STEPS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([s for r in pdf.itertuples() for s in function_steps(r.file, r.text, function)], columns=columns)

    return sources.filter("text IS NOT NULL AND file LIKE '%.py'").select("file", "text").mapInPandas(run, STEPS)


def candidate_dependencies(rows: DataFrame, key: str = "file") -> DataFrame:
    """(``producer``, ``consumer``, ``variable``, ``inputs``) of steps in order whose inputs have the variable's first GRAM characters.

    An inverted index: inputs by their pieces as long as some variable's beginning,
    variables by their beginning, joined on the piece.  Spark takes the size of
    texts and of their pieces from the compressed table and would broadcast them
    through the driver, so the joins are told to shuffle.
    """
    made = rows.select(key, F.col("step").alias("producer"), F.explode("outputs").alias("variable")).filter("variable <> ''").withColumn("piece", F.substring("variable", 1, GRAM))
    lengths = made.groupBy(key).agg(F.collect_set(F.length("piece")).alias("lengths"))  # GRAM at most
    used = rows.select(key, F.col("step").alias("consumer"), "inputs").hint("merge").join(lengths, key)
    pieces = lambda text, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n))
    every = F.flatten(F.transform("lengths", lambda n: F.flatten(F.transform(F.filter("inputs", lambda t: t.isNotNull()), lambda t: pieces(t, n)))))
    index = used.select(key, "consumer", F.explode(F.array_distinct(every)).alias("piece"))
    met = made.hint("merge").join(index, [key, "piece"]).filter("producer < consumer").select(key, "producer", "consumer", "variable")
    return met.hint("merge").join(rows.select(key, F.col("step").alias("consumer"), "inputs"), [key, "consumer"])


def data_dependencies(rows: DataFrame, key: str = "file") -> DataFrame:
    """(``producer``, ``consumer``, ``variable``): an earlier step's output occurs in a later step's inputs.

    ``rows``: ``step``, ``outputs`` and ``inputs`` (arrays of text) for each key.
    Only pairs that an index of pieces brings together are compared.
    """
    found = candidate_dependencies(rows, key).filter(F.exists("inputs", lambda t: F.contains(t, F.col("variable"))))
    return found.select(key, "producer", "consumer", "variable")


def chained(rows: DataFrame, key: str = "file") -> DataFrame:
    """(``step``, ``prior``): each step with the one before it."""
    return rows.withColumn("prior", F.lag("step").over(W.partitionBy(key).orderBy("step"))).filter("prior IS NOT NULL").select(key, "step", "prior")


def dependency_graph(rows: DataFrame, key: str = "file") -> DataFrame:
    """(``source``, ``target``, ``kind``): data dependencies, and the prior step where a step has none."""
    inputs = rows.withColumn("inputs", F.concat("args", F.map_values("kwargs")))
    data = data_dependencies(inputs, key).select(key, F.col("producer").alias("source"), F.col("consumer").alias("target"), F.lit("data").alias("kind")).distinct()
    order = chained(rows, key).select(key, F.col("prior").alias("source"), F.col("step").alias("target"), F.lit("sequence").alias("kind"))
    return data.unionByName(order.join(data.select(key, "target"), [key, "target"], "left_anti").select(*data.columns))


def _grouped(rows: DataFrame, graph: DataFrame) -> tuple[list, list]:
    return rows.orderBy("step").collect(), graph.orderBy("source", "target").collect()  # one function's steps


def mermaid(rows: DataFrame, graph: DataFrame) -> str:
    """A flowchart of one function, steps grouped by loop and condition."""
    own, links = _grouped(rows, graph)
    out, groups = ["flowchart TD"], {}
    for r in own:
        groups.setdefault(r["loop"] or r["condition"], []).append(r)
    for i, (title, members) in enumerate(groups.items()):
        lines = [f'    s{r["step"]}["{r["step"]}. {r["callee"]}"]' for r in members]
        out += [f'  subgraph g{i}["{str(title).replace(chr(34), chr(39))}"]', *lines, "  end"] if title else lines
    return "\n".join([*out, *[f"  s{e['source']} {'-->' if e['kind'] == 'data' else '-.->'} s{e['target']}" for e in links]])


def dot(rows: DataFrame, graph: DataFrame) -> str:
    """The same as a digraph."""
    own, links = _grouped(rows, graph)
    out, groups = ["digraph steps {"], {}
    for r in own:
        groups.setdefault(r["loop"] or r["condition"], []).append(r)
    for i, (title, members) in enumerate(groups.items()):
        lines = [f'    s{r["step"]} [label="{r["step"]}. {r["callee"]}"];' for r in members]
        label = str(title).replace('"', "'")
        out += [f"  subgraph cluster_{i} {{", f'    label="{label}";', *lines, "  }"] if title else lines
    return "\n".join([*out, *[f"  s{e['source']} -> s{e['target']}{'' if e['kind'] == 'data' else ' [style=dashed]'};" for e in links], "}"])
