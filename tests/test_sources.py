import textwrap

import pytest
from pyspark.sql import functions as F

from stemma.operators import findings, flow, resolve
from stemma.sources import files, python_ast, samples, tables
from stemma.sources.other_languages import scan


def module(text, path="pkg/mod.py"):
    return python_ast.Module(path, textwrap.dedent(text))


def by_name(m):
    return {n["qualified_name"]: n for n in m.nodes}


def test_module_entities():
    m = module(
        '''
        """Doc."""
        import os, sys as system
        from typing import TYPE_CHECKING
        LIMIT: int = 3
        if TYPE_CHECKING:
            from a.b import C
        @dataclass(frozen=True)
        class Base:
            """B."""
            size: int = field(default=1)
            def __post_init__(self): pass
        class Kid(Base):
            kind = "k"
            @property
            def name(self, *rest: int, **more) -> str:
                if self.kind and rest or more:
                    return later()
                return Base()
        async def later(x: list[int] = None):
            return [y for y in x if y]
        '''
    )
    n = by_name(m)
    assert n["mod"]["node_type"] == "module" and n["mod"]["docstring"] == "Doc." and n["mod"]["lines_of_code"] == 1
    assert n["mod.LIMIT"]["node_type"] == "variable" and n["mod.LIMIT"]["tags"] == ["module-constant"]
    assert n["mod.Base"]["tags"] == ["dataclass", "frozen"] and n["mod.Base.size"]["node_type"] == "attribute"
    assert n["mod.Kid.name"]["node_type"] == "method" and "property" in n["mod.Kid.name"]["tags"]
    assert n["mod.Kid.name"]["signature"] == "property\ndef name(self, *rest: int, **more) -> str"
    assert n["mod.Kid.name"]["cyclomatic_complexity"] == 4 and n["mod.Kid.name"]["depth"] == 1
    assert n["mod.later"]["signature"] == "async def later(x: list[int])" and n["mod.later"]["cyclomatic_complexity"] == 3
    assert n["mod.later.x"]["node_type"] == "parameter"
    kinds = {(e["edge_type"], e["target_id"]) for e in m.edges.values()}
    assert ("inheritance", n["mod.Base"]["id"]) in kinds and ("call", n["mod.Base"]["id"]) in kinds
    assert ("import_type_only", python_ast.short_hash("external:a.b.C")) in kinds
    assert ("call", python_ast.short_hash("builtin:later")) in kinds  # defined after its caller
    assert n["mod"]["id"] == python_ast.short_hash("module:mod")


def test_chain_resolves_across_definitions(spark):
    text = "def a():\n    b()\ndef b():\n    c()\ndef c():\n    d()\ndef d():\n    pass\n"
    rows = python_ast.parsed(files.text(spark, text, "chain.py"))
    nodes, edges = resolve.resolve_calls(python_ast.nodes_of(rows), python_ast.edges_of(rows))
    assert nodes.filter("node_type = 'builtin'").count() == 0 and edges.count() == 3


def test_samples_parse_and_broken_files_are_reported(spark):
    rows = python_ast.parsed(samples.sources(spark))
    assert {r["file"] for r in python_ast.errors_of(rows).collect()} == {"shop/broken.py"}
    kinds = {r["node_type"] for r in python_ast.nodes_of(rows).select("node_type").distinct().collect()}
    assert {"module", "class", "function", "method", "attribute", "variable", "parameter", "external", "builtin"} <= kinds


def test_complexity(spark):
    text = "class K:\n    def m(self, a):\n        for x in a:\n            if x and a:\n                break\n        assert a\n        return x + 1\n"
    got = {r["name"]: r for r in python_ast.complexity(files.text(spark, text, "k.py")).collect()}
    assert (got["m"]["cyclomatic"], got["m"]["cognitive"], got["m"]["max_nesting"]) == (5, 5, 2)
    assert (got["K"]["cyclomatic"], got["K"]["kind"], got["K"]["volume"]) == (6, "class", 0.0)


@pytest.mark.parametrize(
    "text,rule",
    [
        ("def f(a, b, c, d, e, *, g):\n    pass\n", "too_many_arguments"),
        ("def public():\n    pass\n", "missing_docstring"),
        ("class K:\n    pass\n", "missing_class_docstring"),
        ("try:\n    pass\nexcept:\n    pass\n", None),
        ("def f():\n    try:\n        pass\n    except:\n        pass\n", "bare_except"),
        ("q = 1\n", "single_letter_variable"),
        ("ok = a1 == True\n", "compare_to_true"),
        ("ok = aa == False\n", "compare_to_false"),
        ("ok = aa and bb and cc and dd\n", "long_boolean_expression"),
        ("import aa, bb, cc, dd\n", "many_imports_one_line"),
        ("from os import *\n", "star_import"),
        ("x = 1\n" * 501, "long_file"),
        ("# todo: later\n", "todo_comment"),
        ("  \nprint (1)\n", "print_statement"),
        ("def f(:\n", "syntax_error"),
        ("import os\n", "dangerous_import_os.system"),
        ("eval(zz.decode())\n", "dynamic_eval"),
        ("subject.run()\n", "shell_execution_run"),
        ("def ab12():\n    pass\n", "obfuscated_function_name"),
        ("host = '10.0.0.1'\n", "pattern_6"),
        ("if a:\n  if b:\n    pass\n", None),
        ("def f():\n    if a:\n     if a:\n      if a:\n       if a:\n        if a:\n         pass\n", "deep_nesting"),
    ],
)
def test_findings(text, rule):
    rules = {f["rule"] for f in python_ast.file_findings("f.py", text)}
    assert rule in rules if rule else not rules & {"bare_except", "deep_nesting"}


def test_clean_file_has_no_risk(spark):
    found = python_ast.findings(files.text(spark, 'def f():\n    """D."""\n    return "x"\n', "clean.py"))
    assert found.filter("confidence IS NOT NULL").count() == 0
    risk = findings.file_risk(python_ast.findings(files.text(spark, "eval(aa.decode())\n", "bad.py")).filter("confidence IS NOT NULL")).first()
    assert risk["likely"] and 0 < risk["risk"] <= 1


@pytest.mark.parametrize(
    "lang,path,functions,classes,methods,imports",
    [
        ("javascript", "web/app.js", {"fetchAll", "helper"}, {"View"}, {"constructor", "load"}, {"./a.js"}),
        ("typescript", "web/app.ts", {"measure"}, {"Box"}, {"size"}, {"q"}),
        ("rust", "core/lib.rs", {"make"}, {"Point", "Kind"}, {"new", "len"}, {"std::fmt"}),
        ("go", "svc/main.go", {"main", "helper"}, {"Server"}, {"Run"}, {"fmt"}),
        ("java", "app/Main.java", set(), {"Main"}, {"Main", "getN"}, {"java.util.List"}),
        ("c", "sys/io.c", {"read_all", "main"}, {"buf"}, set(), {"stdio.h"}),
        ("cpp", "sys/box.hpp", {"open_box"}, {"Box"}, set(), {"io.h"}),
    ],
)
def test_other_languages(lang, path, functions, classes, methods, imports):
    nodes, edges = scan(path, samples.OTHER[path], lang)
    named = lambda kind: {n["name"] for n in nodes if n["node_type"] == kind}
    assert (named("function"), named("class"), named("method"), named("external")) == (functions, classes, methods, imports)
    assert sum(n["node_type"] == "module" for n in nodes) == 1 and len({n["id"] for n in nodes}) == len(nodes)
    if lang == "javascript":
        targets = {e["target_id"] for e in edges if e["edge_type"] == "call"}
        assert next(n["id"] for n in nodes if n["name"] == "fetchAll") in targets


def test_directory_scan_and_detection(spark, tmp_path):
    for path, text in {**samples.PYTHON, **samples.OTHER}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / path).write_text(text)
    rows = files.directory(spark, str(tmp_path))
    full = {p for p, t in {**samples.PYTHON, **samples.OTHER}.items() if t and not p.endswith(".txt")}
    assert {r["file"].removeprefix(f"{tmp_path}/") for r in rows.collect()} == full
    assert files.directory(spark, str(tmp_path), "*.py").count() == sum(p.endswith(".py") for p in full)
    assert files.detected_pattern(rows) == "*.js" and files.detected_pattern(rows.filter("file LIKE '%.py'")) == "*.py"


def test_flow(spark):
    rows = flow.steps(samples.sources(spark), "main")
    got = {r["step"]: r for r in rows.collect()}
    assert [got[i]["callee"] for i in sorted(got)] == ["load", "count", "total", "emit"]
    assert got[1]["label"] == "Load" and got[2]["outputs"] == ["(n)"] and got[3]["loop"] == "for item in items"
    graph = flow.dependency_graph(rows)
    links = {(r["source"], r["target"], r["kind"]) for r in graph.collect()}
    assert links == {(1, 2, "sequence"), (2, 3, "sequence"), (3, 4, "data")}
    own, rest = rows.filter("file = 'shop/cart.py'"), graph.filter(F.col("file") == "shop/cart.py")
    assert flow.mermaid(own, rest).startswith("flowchart TD") and flow.dot(own, rest).endswith("}")
    assert flow.steps(samples.sources(spark), "nobody").count() == 0


def test_made_sources_are_dealt_out_by_their_number(spark, tmp_path, monkeypatch):
    """A small table of parts is one file and one task, what is parsed of it is not."""
    spark.range(100).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(tables, "FILES", 20, raising=False)
    for sources in (tables.python_sources, tables.script_sources):
        sizes = [len(p) for p in sources(spark, str(tmp_path)).rdd.glom().collect()]
        assert len(sizes) == 5 and sum(sizes) == 100 and max(sizes) < 40


def test_dependencies_broadcast_no_texts(spark, tmp_path):
    """Texts and their pieces are far larger than Spark believes: none may go through the driver."""
    rows = spark.createDataFrame([("f", 1, ["alpha"], ["x"]), ("f", 2, ["beta"], ["an alphabet"]), ("f", 3, [""], ["beta of alpha"]), ("g", 1, ["beta"], ["alpha"])], "file string, step long, outputs array<string>, inputs array<string>")
    rows.write.parquet(str(tmp_path / "rows"))
    found = flow.data_dependencies(spark.read.parquet(str(tmp_path / "rows")))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("f", 1, 2, "alpha"), ("f", 1, 3, "alpha"), ("f", 2, 3, "beta")]
