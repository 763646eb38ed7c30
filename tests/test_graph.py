import pytest

from stemma.operators import clusters, communities, graph, paths, resolve
from stemma.plans import cypher
from stemma.plans.store import GraphStore


@pytest.fixture(scope="module")
def small(spark):
    """A module over three functions, of which one calls the next, and a variable."""
    nodes = [
        ("mod1", "module", "mod1", "m.py", 1, 0, 90.0, 2.0, 100, 0, "healthy", 1.0),
        ("fn_healthy", "function", "m.fn_healthy", "m.py", 2, 1, 85.0, 3.0, 15, 0, "healthy", 1.0),
        ("fn_stressed", "function", "m.fn_stressed", "m.py", 20, 25, 0.0, 30.0, 35, 8, "stressed", 0.02),
        ("fn_inflamed", "function", "m.fn_inflamed", "m.py", 30, 40, 0.0, 50.0, 30, 10, "inflamed", 0.0),
        ("var1", "variable", "m.var1", "m.py", None, None, None, None, None, None, None, None),
    ]
    schema = "id string, node_type string, qualified_name string, file string, cyclomatic_complexity long, cognitive_complexity long, maintainability_index double, halstead_difficulty double, lines_of_code long, depth long, status string, score double"
    edges = [("mod1", "fn_healthy", "contains", 1.0), ("mod1", "fn_stressed", "contains", 1.0), ("mod1", "fn_inflamed", "contains", 1.0), ("fn_healthy", "fn_stressed", "call", 1.0), ("fn_stressed", "fn_inflamed", "call", 1.0), ("fn_healthy", "var1", "reference", 0.5)]
    rows = spark.createDataFrame(nodes, schema)
    return rows.withColumn("name", rows.id), spark.createDataFrame([(f"e{i}", *e) for i, e in enumerate(edges)], "id string, source_id string, target_id string, edge_type string, weight double")


def levels(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["depth"], set()).add(r["id"])
    return out


def chain(spark, links):
    return spark.createDataFrame([(f"{a}{b}", a, b, "call", 1.0) for a, b in links], "id string, source_id string, target_id string, edge_type string, weight double")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_impact(spark, small):
    _, edges = small
    assert levels(graph.impact(edges, ids(spark, "fn_inflamed"))) == {1: {"fn_stressed", "mod1"}, 2: {"fn_healthy"}}
    assert levels(graph.impact(edges, ids(spark, "fn_healthy"), "downstream", 2)) == {1: {"fn_stressed", "var1"}, 2: {"fn_inflamed"}}
    assert graph.impact(edges, ids(spark, "nobody")).count() == 0


def test_impact_keeps_the_least_depth_and_leaves_the_target_out(spark):
    edges = chain(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")])
    assert levels(graph.impact(edges, ids(spark, "a"), "downstream", 5)) == {1: {"b", "c"}}


def test_strong_components_and_cycles(spark):
    edges = chain(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("x", "a"), ("e", "y")])
    got = {}
    for r in graph.strong_components(edges).collect():
        got.setdefault(r["component"], set()).add(r["id"])
    assert sorted(map(sorted, got.values())) == [["a", "b", "c"], ["d", "e"], ["f"]]
    assert sorted(r["size"] for r in graph.cycles(edges).collect()) == [1, 2, 3]
    assert graph.cycles(edges.limit(0)).count() == 0


def test_depth_first_cycles():
    assert graph.depth_first_cycles({"a": ["b"], "b": ["c", "b"], "c": ["a"]}) == [["a", "b", "c"], ["b"]]
    assert graph.depth_first_cycles({"a": ["b"], "b": []}) == []


def test_degrees_and_induced(spark, small):
    nodes, edges = small
    d = {r["id"]: (r["fan_out"], r["fan_in"]) for r in graph.degrees(edges).collect()}
    assert d["fn_healthy"] == (2, 1) and d["var1"] == (0, 1)
    assert graph.induced(nodes.filter("node_type = 'function'"), edges).count() == 2
    assert [r["id"] for r in graph.hotspots(nodes).collect()] == ["fn_inflamed", "fn_stressed", "fn_healthy"]
    assert [r["id"] for r in graph.unhealthy(nodes).collect()] == ["fn_inflamed", "fn_stressed"]


def test_resolution(spark):
    nodes = spark.createDataFrame([("b1", "builtin", "helper"), ("b2", "builtin", "log"), ("b3", "builtin", "twice"), ("f1", "function", "helper"), ("t1", "function", "twice"), ("t2", "method", "twice"), ("c", "function", "caller")], "id string, node_type string, name string")
    edges = spark.createDataFrame([("1", "c", "b1", "call"), ("2", "c", "b2", "call"), ("3", "c", "b3", "call"), ("4", "c", "b1", "import")], "id string, source_id string, target_id string, edge_type string")
    left, moved = resolve.resolve_calls(nodes, edges.filter("edge_type = 'call'"))
    assert {(r["target_id"], r["edge_type"]) for r in moved.collect()} == {("f1", "call"), ("b2", "call"), ("b3", "call")}
    assert {r["id"] for r in left.filter("node_type = 'builtin'").collect()} == {"b2", "b3"}
    _, kept = resolve.resolve_calls(nodes, edges)
    assert ("b1", "import") in {(r["target_id"], r["edge_type"]) for r in kept.collect()}


def test_processes(spark):
    names = ["a", "b", "c", "d", "e"]
    nodes = spark.createDataFrame([(n, "function", n, i) for i, n in enumerate(names)] + [("x", "builtin", "b", 9)], "id string, node_type string, name string, seq long")
    edges = chain(spark, [("a", "x"), ("b", "c"), ("c", "d"), ("a", "c"), ("e", "a")])
    rows = paths.processes(nodes, edges).collect()
    assert [r["name"] for r in rows] == ["e -> a -> b -> c -> d"]
    assert [s["step"] for s in rows[0]["steps"]] == [0, 1, 2, 3, 4] and (rows[0]["entry"], rows[0]["terminal"]) == ("e", "d")
    assert paths.processes(nodes, edges.limit(0)).count() == 0


def test_paths_stop_at_cycles(spark):
    got = paths.simple_paths(ids(spark, "a"), chain(spark, [("a", "b"), ("b", "a"), ("b", "c")]).select("source_id", "target_id"))
    assert [r["path"] for r in got.collect()] == [["a", "b", "c"]]


def test_paths_are_counted_without_being_made(spark):
    """60 x 60 x 60 paths between one start and one end, and a start of one path; the loop and the shorter way don't count."""
    names = lambda k: [f"{k}{i:02d}" for i in range(60)]
    wide = [("a", m) for m in names("m")] + [(m, n) for m in names("m") for n in names("n")] + [(n, e) for n in names("n") for e in names("z")]
    more = [("b", "m07"), ("b", "z00"), ("m07", "m07"), ("c", "d")]
    got = {r["start"]: (r["paths"], r["least"], r["most"]) for r in paths.totals(chain(spark, wide + more).select("source_id", "target_id"), 3).collect()}
    assert got == {"a": (216_000, "a m00 n00 z00", "a m59 n59 z59"), "b": (3_600, "b m07 n00 z00", "b m07 n59 z59")}


def test_processes_are_made_from_the_starts_that_can_lead(spark, monkeypatch):
    """Of 300 starts of three nodes and two of four, one of which only repeats a part, the first three paths; few starts are followed."""
    links = [(f"s{i:03d}", f"m{i % 7}") for i in range(300)] + [(f"m{i}", f"z{j}") for i in range(7) for j in range(2)]
    links += [("u", "v"), ("v", "w"), ("w", "x"), ("u", "w"), ("s299", "m1"), ("s298", "m3"), ("s298", "m2")]
    edges = chain(spark, links)
    nodes = spark.createDataFrame([(n, "function", n, 0) for n in {e for link in links for e in link}], "id string, node_type string, name string, seq long")
    followed, whole = [], paths.simple_paths
    monkeypatch.setattr(paths, "simple_paths", lambda starts, *rest: followed.append(starts.count()) or whole(starts, *rest))
    got = [(r["process_id"], r["name"]) for r in paths.processes(nodes, edges, most=3).orderBy("process_id").collect()]
    assert got == [("process_0", "u -> v -> w -> x"), ("process_1", "s298 -> m2 -> z0"), ("process_2", "s298 -> m2 -> z1")]
    assert sum(followed) < 10


def test_communities_partition_structural_nodes(spark):
    rows = []
    for m in ("red", "blue"):
        rows += [(f"{m}", "module", m, m)] + [(f"{m}{i}", "function", f"paint{m.title()}Wall{i}", f"{m}.f{i}") for i in range(6)]
    nodes = spark.createDataFrame([*rows, ("v", "variable", "v", "red.v")], "id string, node_type string, name string, qualified_name string")
    edges = chain(spark, [(f"{m}{i}", f"{m}{j}") for m in ("red", "blue") for i in range(6) for j in range(6) if i != j])
    members, _ = communities.assigned(nodes, edges)
    assert members.count() == 14 and members.select("id").distinct().count() == 14
    described = communities.communities(nodes, edges, resolution=1.0).collect()
    assert len(described) == 2 and all(0 <= r["cohesion"] <= 1 for r in described)
    assert {r["community_id"] for r in described} == {"community_0", "community_1"}
    assert {r["name"] for r in described} == {"Red", "Blue"} or all(r["name"] for r in described)
    two, _ = communities.assigned(nodes.limit(2), edges)
    assert two.select("community").distinct().count() == 1


def test_small_groups_merge(spark):
    state = spark.createDataFrame([(f"a{i}", "A") for i in range(4)] + [("b0", "B"), ("c0", "C")] + [(f"d{i}", "D") for i in range(3)], "id string, community string")
    links = spark.createDataFrame([("a0", "b0"), ("b0", "d1"), ("b0", "d2")], "a string, b string")
    got = {r["id"]: r["community"] for r in communities.merged_small(state, links).collect()}
    assert got["b0"] == "D" and got["c0"] == "A" and got["a1"] == "A"


def test_clusters(spark):
    members = spark.createDataFrame([("1", "p", "function", "healthy", 3), ("2", "p", "class", "stressed", 4), ("3", "q", "method", "stressed", 5)], "id string, cluster string, node_type string, status string, lines_of_code long")
    got = {r["cluster"]: r for r in clusters.rolled_up(members).collect()}
    assert (got["p"]["total_nodes"], got["p"]["total_lines"], got["p"]["dominant_health"], got["p"]["health_score"]) == (2, 7, "healthy", 50.0)
    assert got["q"]["dominant_health"] == "stressed" and got["q"]["total_functions"] == 1
    tree = clusters.directories(spark.createDataFrame([("r/a/x",), ("r/b/y",), ("r/b/z",)], "path string"))
    assert sorted(r["directory"] for r in clusters.roots(tree).collect()) == ["r/a", "r/b"]
    assert sorted((r["directory"], r["n"]) for r in clusters.expanded(tree, "r/b").collect()) == [("r/b/y", 1), ("r/b/z", 1)]


def test_hierarchy(spark):
    nodes = spark.createDataFrame([("1", "a/x"), ("2", "a/y"), ("3", "b/z")], "id string, file string")
    links = spark.createDataFrame([("1", "3")], "a string, b string")
    tree = clusters.hierarchy(nodes, links)
    assert {r["cluster"] for r in clusters.at_level(tree, 0).collect()} == {"root"}
    assert {r["child"] for r in clusters.children(tree, "a").collect()} == {"1", "2"}
    assert clusters.at_level(tree, 9).count() == 0


def test_store_round_trip(spark, small, tmp_path):
    nodes, edges = small
    store = GraphStore.opened(spark, str(tmp_path / "g"))
    assert store.count_nodes() == 0
    for _ in range(2):
        assert store.save(nodes, edges).count() == 0
    assert (store.count_nodes(), store.relation_count()) == (5, 6)
    counts = {r["label"]: r["n"] for r in store.label_counts().collect()}
    assert counts == {"Module": 1, "Package": 0, "Class": 0, "Function": 3, "Method": 0, "Variable": 1, "External": 0, "Community": 0, "Process": 0}
    assert [r["uid"] for r in store.hotspots().collect()] == ["fn_inflamed", "fn_stressed", "fn_healthy"]
    assert {r["uid"] for r in store.unhealthy().collect()} == {"fn_inflamed", "fn_stressed"}
    assert {r["id"] for r in store.impact("fn_inflamed").collect()} == {"fn_stressed", "mod1", "fn_healthy"}
    assert store.save(nodes, edges.unionByName(chain(spark, [("fn_healthy", "ghost")]))).count() == 1


def test_cypher(spark, small, tmp_path):
    store = GraphStore.opened(spark, str(tmp_path / "g"))
    store.save(*small)
    assert store.query("MATCH (n) RETURN count(n) AS n") == [{"n": 5}]
    assert store.query("MATCH (n:Function {name: $who}) RETURN n.name AS a, n.lines_of_code AS loc", {"who": "fn_stressed"}) == [{"a": "fn_stressed", "loc": 35}]
    assert store.query("MATCH (f:Function) WHERE f.health_score < 0.5 RETURN f.name ORDER BY f.health_score LIMIT 1") == [{"f.name": "fn_inflamed"}]
    assert store.query("MATCH (a)-[r:CodeRelation {kind:'call'}]->(b) RETURN a.name, b.name ORDER BY b.name") == [{"a.name": "fn_stressed", "b.name": "fn_inflamed"}, {"a.name": "fn_healthy", "b.name": "fn_stressed"}]
    assert store.query("MATCH (a)-[r:CodeRelation]->(b {uid:$u}) RETURN a.uid AS a ORDER BY a", {"u": "fn_stressed"}) == [{"a": "fn_healthy"}, {"a": "mod1"}]
    assert store.query("MATCH (b {uid:'mod1'})-[r]->(a) RETURN count(r) AS n") == [{"n": 3}]
    assert store.query("MATCH ()-[r:CodeRelation]->() RETURN count(r) AS cnt") == [{"cnt": 6}]
    assert store.query("MATCH (n:Function) RETURN n.health_status AS s, count(n) AS c ORDER BY s") == [{"s": "healthy", "c": 1}, {"s": "inflamed", "c": 1}, {"s": "stressed", "c": 1}]
    assert store.query("MATCH (f:Module) RETURN f")[0]["f"]["uid"] == "mod1"
    assert store.query("MATCH (n:Function) WHERE n.name CONTAINS 'fla' OR NOT n.cyclomatic_complexity > 2 RETURN DISTINCT n.name AS n ORDER BY n DESC") == [{"n": "fn_inflamed"}, {"n": "fn_healthy"}]
    store.query("CREATE (n:External {uid: 'x', name: 'lib', kind: 'external'})")
    store.query("MATCH (a:Module {uid: 'mod1'}), (b:External {uid: 'x'}) CREATE (a)-[:CodeRelation {kind: 'import', weight: 0.5}]->(b)")
    assert store.query("MATCH (a)-[r {kind: 'import'}]->(b) RETURN a.uid AS a, b.name AS b, r.weight AS w") == [{"a": "mod1", "b": "lib", "w": 0.5}]
    store.query("MATCH (n:External) DETACH DELETE n")
    assert store.query("MATCH (n) RETURN count(n) AS n") == [{"n": 5}] and store.relation_count() == 6
    for bad in ("MATCH (n", "RETURN 1", "MATCH (n) RETURN n.name WHERE", "MATCH (n) WHERE n.x ~ 1 RETURN n", "MATCH (a), (b) RETURN a.name"):
        with pytest.raises(cypher.QueryError):
            store.query(bad)
