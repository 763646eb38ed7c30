import json

import pytest

from stemma import cli
from stemma.functions import udtf
from stemma.sources import samples


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("src")
    for path, text in samples.PYTHON.items():
        (root / path).parent.mkdir(exist_ok=True)
        (root / path).write_text(text)
    return str(root)


def ran(capsys, *argv):
    assert cli.main(list(argv)) == 0
    return json.loads(capsys.readouterr().out)


def test_analyze_and_health(spark, folder, capsys):
    out = ran(capsys, "analyze", folder)
    assert set(out) == {"nodes", "edges", "stats"} and out["stats"]["total_nodes"] == len(out["nodes"])
    assert {"healthy"} <= {n["status"] for n in out["nodes"]}
    notes = {r["name"]: r for r in ran(capsys, "health", folder)}
    assert notes["_unused"]["status"] == "necrotic"


def test_index_and_query(spark, folder, capsys, tmp_path):
    db = str(tmp_path / "db")
    out = ran(capsys, "index", folder, "--db", db)
    assert out["nodes_indexed"] > 10 and out["communities"] >= 1 and out["processes"] >= 1
    assert ran(capsys, "query", db, "--cypher", "MATCH (f:Function {name: 'main'}) RETURN f.name AS n") == [{"n": "main"}]
    assert ran(capsys, "query", db, "--hotspots")[0]["label"] == "Function"
    assert isinstance(ran(capsys, "query", db, "--unhealthy"), list)
    assert ran(capsys, "query", db, "--stats")["labels"]["Community"] == out["communities"]
    up = ran(capsys, "impact-graph", db, "rounded")
    assert {r["name"] for r in up["depth_1"]} >= {"gross"} and set(up) == {"depth_1", "depth_2", "depth_3"}
    with pytest.raises(SystemExit):
        cli.main(["query", db])


def test_other_commands(spark, folder, capsys):
    assert {r["name"] for r in ran(capsys, "impact", folder, "main", "--depth", "1")["depth_1"]} >= {"load", "summary", "count"}
    assert ran(capsys, "communities", folder) and ran(capsys, "processes", folder)
    assert ran(capsys, "complexity", folder)["summary"]["units"] >= 10
    assert ran(capsys, "findings", folder)["corpus"]["any_likely"]
    assert [s["callee"] for s in ran(capsys, "steps", folder, "main")["steps"]] == ["load", "count", "total", "emit"]
    assert cli.main(["steps", folder, "main", "--format", "dot"]) == 0 and capsys.readouterr().out.startswith("digraph")
    assert cli.main(["analyze", folder + "/nowhere"]) == 1


def test_table_functions(spark):
    udtf.register(spark)
    samples.sources(spark).createOrReplaceTempView("own_sources")
    count = lambda q: spark.sql(q).count()
    assert count("SELECT p.* FROM own_sources s, LATERAL parse_source(s.file, s.text) p WHERE p.kind = 'class'") == 2
    assert count("SELECT p.* FROM own_sources s, LATERAL scan_source(s.file, s.text) p WHERE p.rule = 'syntax_error'") == 1
    assert count("SELECT p.* FROM own_sources s, LATERAL source_complexity(s.file, s.text) p WHERE p.kind = 'class'") == 2
    assert count("SELECT p.* FROM own_sources s, LATERAL source_steps(s.file, s.text, 'main') p") == 4


def test_report_and_export(spark, folder, capsys, tmp_path):
    assert cli.main(["report", folder]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert " nodes, " in lines[0] and "hotspots" in lines[1] and lines[2].startswith("healthy ")
    assert any(x.startswith("necrotic") and "_unused" in x for x in lines[3:]) and len(lines) <= 23
    out = ran(capsys, "export", folder, "--out", str(tmp_path / "graph"))
    assert spark.read.json(out["out"] + "/nodes").count() == out["nodes"] > 10


def test_record_and_replay(spark, capsys, tmp_path):
    program = tmp_path / "prog.py"
    program.write_text("def f(x):\n    return x + 1\n\nf(1)\nf(2)\n")
    out = ran(capsys, "record", str(program), "--out", str(tmp_path / "rec"))
    assert (out["calls"], out["frames"], out["exceptions"]) == (3, 6, 0)
    replay = ran(capsys, "frames", str(tmp_path / "rec"), "--speed", "2")
    assert replay["sessions"][0]["total_frames"] == 6 and replay["frames"][0]["label"] == "Frame 1 / 6"
    assert [r["qualified_name"] for r in replay["frames"]][:3] == ["prog.<module>", "prog.f", "prog.f"]
