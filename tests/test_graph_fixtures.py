"""Small graphs with known answers."""

from pyspark.sql import functions as F

from graphlens.functions.scale import materialize
from graphlens.operators import change, enrich, link, resolve, traverse, views
from graphlens.sources import sinks


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def node(fqn, kind, **more):
    return {"fqn": fqn, "kind": kind, **more}


def calls_fixture(extra=()):
    nodes = [node(f"com.app.{c}", "CLASS") for c in "ABC"] + [
        node(f, "FUNCTION") for f in ("com.app.A.m1", "com.app.A.m2", "com.app.B.m1", "com.app.C.m1")
    ]
    edges = [(n["fqn"].rsplit(".", 1)[0], n["fqn"], "CONTAINS") for n in nodes[3:]]
    edges += [("com.app.A.m1", "com.app.B.m1", "CALLS"), ("com.app.A.m2", "com.app.B.m1", "CALLS"), ("com.app.B.m1", "com.app.C.m1", "CALLS")]
    return nodes, edges + list(extra)


def test_fan_metrics(make_graph):
    g = make_graph(*calls_fixture())
    assert got(enrich.fan_metrics(g), "class_fqn", "fan_in", "fan_out") == [("com.app.A", 0, 2), ("com.app.B", 2, 1), ("com.app.C", 1, 0)]


def test_fan_in_counts_injections(make_graph):
    g = make_graph([node("A", "CLASS"), node("B", "CLASS")], [("A", "B", "INJECTS")])
    assert got(enrich.fan_metrics(g), "class_fqn", "fan_in", "fan_out") == [("A", 0, 0), ("B", 1, 0)]


def test_class_and_module_roll_up(make_graph):
    nodes, edges = calls_fixture([("com.app.A", "com.app.B", "DEPENDS_ON")])
    g = make_graph(nodes, edges)
    assert got(enrich.class_dependencies(g), "src", "dst", "weight") == [("com.app.B", "com.app.C", 1)]
    nodes += [node("m1", "MODULE"), node("m2", "MODULE")]
    edges += [("m1", "com.app.A", "CONTAINS"), ("m2", "com.app.B", "CONTAINS"), ("m2", "com.app.C", "CONTAINS")]
    g = make_graph(nodes, edges)
    g = g.plus(edges=enrich.class_dependencies(g))
    assert got(enrich.module_imports(g), "src", "dst", "weight") == [("m1", "m2", 1)]


def test_layers_and_technologies(make_graph):
    g = make_graph(
        [
            node("A", "CLASS", annotations=["Lazy", "Service"], loc=10), node("B", "CLASS", layer="Presentation", language="go", loc=5),
            node("T", "TABLE", props={"engine": "postgresql"}),
        ],
        [],
    )
    none = g.nodes.select("app_name", "fqn", F.lit("x").alias("layer"), "seq").limit(0)
    g = type(g)(enrich.apply_layers(g, none), g.edges)
    assert got(enrich.layer_nodes(g), "name", "node_count") == [("Business Logic", 1), ("Presentation", 1)]
    assert got(enrich.technology_nodes(g), "name", "class_count", "loc_total", "table_count") == [
        ("Go Classes", 1, 5, 0), ("PostgreSQL", 0, 0, 1), ("Spring Boot", 1, 10, 0),
    ]


def test_virtual_dispatch_either_direction(make_graph):
    nodes = [node("I", "INTERFACE"), node("C", "CLASS"), node("I.m", "FUNCTION"), node("C.m", "FUNCTION")]
    held = [("I", "I.m", "CONTAINS"), ("C", "C.m", "CONTAINS"), ("C", "I", "IMPLEMENTS")]
    for links in ([("C.m", "I.m", "IMPLEMENTS")], [("I.m", "C.m", "IMPLEMENTS")], [("C.m", "I.m", "IMPLEMENTS"), ("I.m", "C.m", "IMPLEMENTS")]):
        assert got(enrich.virtual_dispatch(make_graph(nodes, held + links)), "src", "dst") == [("I.m", "C.m")]


def test_orphan_modules(make_graph):
    g = enrich.prune_orphan_modules(make_graph(
        [node("p", "MODULE"), node("q", "MODULE"), node("A", "CLASS")], [("p", "A", "CONTAINS"), ("p", "q", "IMPORTS")]
    ))
    assert got(g.nodes, "fqn") == [("A",), ("p",)]
    assert got(g.edges, "kind") == [("CONTAINS",)]


def test_http_links(make_graph):
    g = make_graph(
        [
            node("ep1", "API_ENDPOINT", method="GET", props={"path": "/api/users/{id}"}), node("ep2", "API_ENDPOINT", method="get", props={"path": "/api/all"}),
            node("f", "FUNCTION", http_calls=[("GET", "/api/users/123"), ("GET", "https://h/api/ALL/?x=1"), ("POST", "/api/all"), ("GET", "/none")]),
        ],
        [],
    )
    assert got(link.http_links(g), "src", "dst", "confidence") == [("f", "ep1", 2), ("f", "ep2", 3)]


def test_topics(make_graph):
    g = make_graph(
        [node("p", "FUNCTION", mq_produces=[("order.created", "rabbitmq")]), node("c", "FUNCTION", mq_consumes=[("order.*", "rabbitmq"), ("no.*", None)])], []
    )
    out = link.topic_links(g)
    assert got(out.nodes, "fqn") == [("topic:order.created",)]
    assert got(out.edges, "src", "dst", "kind", "confidence", "evidence") == [
        ("c", "topic:order.created", "CONSUMES", 2, "cross-tech-linker-wildcard"), ("p", "topic:order.created", "PRODUCES", 3, "cross-tech-linker"),
    ]


def test_shared_tables(make_graph):
    g = make_graph(
        [node("com.app.orders.OrderEntity", "CLASS"), node("com.app.reporting.OrderReadModel", "CLASS", module="reporting"), node("com.app.orders.Other", "CLASS")],
        [("com.app.orders.OrderEntity", "table:orders", "MAPS_TO"), ("com.app.reporting.OrderReadModel", "table:orders", "MAPS_TO"), ("com.app.orders.Other", "table:x", "MAPS_TO")],
    )
    members = link.shared_table_members(g)
    assert got(members, "table_fqn", "module") == [("table:orders", "orders"), ("table:orders", "reporting")]
    every = g.nodes.select("fqn")
    assert got(link.shared_table_edges(members, every), "src", "dst", "confidence") == [("com.app.orders.OrderEntity", "com.app.reporting.OrderReadModel", 2)]


def flow(make_graph, spark, nodes, edges, entry, depth=15):
    g = make_graph(nodes, edges)
    members = traverse.flow_members(g, spark.createDataFrame([(entry,)], "fqn string"), depth)
    return got(members, "position", "node", "depth"), got(traverse.flow_terminals(g, members), "node", "terminal_type")


def test_transaction_flows(make_graph, spark):
    def functions(*names):
        return [node(n, "FUNCTION") for n in names]

    members, ends = flow(make_graph, spark, functions("A.handle", "B.process", "C.save") + [node("users", "TABLE")], [
        ("A.handle", "B.process", "CALLS"), ("B.process", "C.save", "CALLS"), ("C.save", "users", "WRITES")], "A.handle")
    assert members == [(0, "A.handle", 0), (1, "B.process", 1), (2, "C.save", 2)] and ends == [("C.save", "TABLE_WRITE")]
    members, _ = flow(make_graph, spark, functions("A", "B", "C"), [("A", "B", "CALLS"), ("B", "C", "CALLS"), ("C", "A", "CALLS")], "A")
    assert [m[1:] for m in members] == [("A", 0), ("B", 1), ("C", 2)]
    chain = [f"N{i}" for i in range(20)]
    members, _ = flow(make_graph, spark, functions(*chain), [(a, b, "CALLS") for a, b in zip(chain, chain[1:])], "N0", depth=5)
    assert len(members) == 6
    members, _ = flow(make_graph, spark, functions("A.h", "B.<init>", "C.p", "D.x"), [("A.h", "B.<init>", "CALLS"), ("B.<init>", "D.x", "CALLS"), ("A.h", "C.p", "CALLS")], "A.h")
    assert [m[1] for m in members] == ["A.h", "C.p"]


def test_transactions_write_graph(make_graph, spark):
    g = make_graph([node("a.h", "FUNCTION"), node("t", "TABLE")], [("a.h", "t", "WRITES")])
    points = spark.createDataFrame([("a.h", "http_endpoint", {"method": "GET", "path": "/x"})], "fqn string, kind string, metadata map<string,string>")
    out = traverse.transactions(g, points)
    assert got(out.nodes, "fqn") == [("txn:GET /x -> h",)]
    assert got(out.edges, "dst", "kind") == [("a.h", "ENDS_AT"), ("a.h", "INCLUDES"), ("a.h", "STARTS_AT"), ("t", "INCLUDES")]


def test_upstream_skips_own_members_and_reports_hops(make_graph, spark):
    g = make_graph(
        [node("C", "CLASS"), node("C.m", "FUNCTION"), node("C.n", "FUNCTION"), node("X", "FUNCTION"), node("Y", "FUNCTION")],
        [("C", "C.m", "CONTAINS"), ("C", "C.n", "CONTAINS"), ("C.n", "C.m", "CALLS"), ("X", "C.m", "CALLS"), ("Y", "X", "CALLS")],
    )
    seeds = spark.createDataFrame([("C",)], "fqn string")
    assert got(traverse.impact_upstream(g, seeds), "node", "depth", "hops") == [("X", 1, 1), ("Y", 1, 2)]
    assert got(traverse.impact_upstream(g, seeds, exclude_members=False), "node", "hops") == [("C.n", 1), ("X", 1), ("Y", 2)]


def test_trace_hides_interface_methods(make_graph, spark):
    g = make_graph(
        [node("c", "FUNCTION"), node("I.m", "FUNCTION"), node("Repo.m", "FUNCTION"), node("t", "TABLE")],
        [("c", "I.m", "CALLS"), ("I.m", "Repo.m", "IMPLEMENTS"), ("Repo.m", "t", "WRITES")],
    )
    nodes, edges = traverse.trace_route(g, spark.createDataFrame([("c",)], "fqn string"))
    assert got(nodes, "node", "depth", "sequence", "layer") == [("Repo.m", 2, 1, "repository"), ("t", 3, 2, "database")]
    assert got(edges, "source", "target", "type", "sequence") == [("Repo.m", "t", "WRITES", 2)]


def test_shortest_path_is_a_path(make_graph, spark):
    g = make_graph([node(n, "FUNCTION") for n in "abcdef"], [("a", "b", "CALLS"), ("c", "b", "CALLS"), ("c", "d", "READS"), ("a", "e", "CALLS"), ("e", "f", "CALLS"), ("f", "d", "CALLS")])
    pairs = spark.createDataFrame([("a", "d"), ("a", "a"), ("a", "zz")], "from_fqn string, to_fqn string")
    path = got(traverse.shortest_paths(g, pairs), "from_fqn", "to_fqn", "position", "node", "via", "forward")
    assert [p for p in path if p[:2] == ("a", "d")] in (
        [("a", "d", 0, "a", None, None), ("a", "d", 1, "b", "CALLS", True), ("a", "d", 2, "c", "CALLS", False), ("a", "d", 3, "d", "READS", True)],
        [("a", "d", 0, "a", None, None), ("a", "d", 1, "e", "CALLS", True), ("a", "d", 2, "f", "CALLS", True), ("a", "d", 3, "d", "CALLS", True)],
    )
    assert [p for p in path if p[:2] == ("a", "a")] == [("a", "a", 0, "a", None, None)]
    assert not [p for p in path if p[1] == "zz"]


def test_diff_branches(make_graph, spark):
    g = make_graph([
        node("C", "CLASS", path="a.py", line=1, end_line=100), node("C.m", "FUNCTION", path="a.py", line=10, end_line=20), node("C.n", "FUNCTION", path="a.py", line=30, end_line=40),
        node("D", "CLASS", path="b.py", line=1, end_line=9),
    ], [])
    rows = [
        (1, "a.py", "modified", None, [(1, 1, 15, 2)]), (1, "new.py", "added", None, []), (1, "b.py", "deleted", None, []),
        (1, "moved.py", "renamed", "a.py", [(1, 1, 35, 1)]), (1, "none.txt", "modified", None, []),
    ]
    diffs = spark.createDataFrame(rows, "pr_id int, path string, status string, old_path string, hunks array<struct<old_start:int,old_count:int,new_start:int,new_count:int>>")
    changed, files = change.map_diffs(g, diffs)
    assert got(changed, "path", "fqn", "change_type") == [
        ("a.py", "C", "modified"), ("a.py", "C.m", "modified"), ("b.py", "D", "deleted"), ("moved.py", "C", "renamed"), ("moved.py", "C.n", "renamed"),
    ]
    assert got(files, "path", "outcome") == [("b.py", "deleted"), ("new.py", "new"), ("none.txt", "non_graph")]


def test_risk_levels(spark):
    rows = spark.createDataFrame([(4, False, 0, 0, 0), (25, False, 0, 0, 0), (25, False, 1, 0, 0), (51, True, 0, 0, 0), (51, True, 1, 0, 0)], "b int, h boolean, c int, f int, l int")
    score = change.risk_score(F.col("b"), F.col("h"), F.col("c"), F.col("f"), F.col("l"))
    assert [r[0] for r in rows.select(change.risk_level(score)).collect()] == ["Low", "Low", "Medium", "Medium", "High"]


def test_symbol_merge_renames_and_confirms(make_graph, spark):
    g = make_graph(
        [node("UserService", "CLASS", path="src/U.java", line=10), node("caller", "FUNCTION", path="src/A.java", line=1, end_line=9), node("x.run", "FUNCTION", path="src/B.java", line=3)],
        [("UserService", "caller", "CONTAINS"), ("caller", "x.run", "CALLS", {"confidence": 1})],
    )
    base = "semanticdb maven maven/g/a 1.0 "
    occurrences = spark.createDataFrame(
        [("src/U.java", base + "com/example/UserService#", 1, 10, 0), ("src/U.java", base + "com/example/UserService#field.", 1, 10, 1), ("./src/A.java", base + "x/run().", 8, 5, 2)],
        "relative_path string, symbol string, roles int, start_line int, seq bigint",
    )
    info = spark.createDataFrame([(base + "com/example/UserService#", ["doc"], [])], "symbol string, documentation array<string>, relationships array<struct<symbol:string,is_implementation:boolean>>")
    out, _ = resolve.merge_symbols(g, occurrences, info)
    assert "com.example.UserService" in [r[0] for r in got(out.nodes, "fqn")]
    assert got(out.edges, "src", "dst", "kind", "confidence", "evidence") == [
        ("caller", "x.run", "CALLS", 3, "scip"), ("com.example.UserService", "caller", "CONTAINS", 3, "test"),
    ]


def test_storage_round_trip(make_graph, spark, tmp_path):
    g = make_graph(
        [node("org.petclinic", "MODULE"), node("org.petclinic.Owner", "CLASS", line=10, end_line=50, loc=40), node("org.petclinic.Owner.getName", "FUNCTION", line=30, end_line=32)],
        [("org.petclinic", "org.petclinic.Owner", "CONTAINS"), ("org.petclinic.Owner", "org.petclinic.Owner.getName", "CONTAINS"), ("org.petclinic.Owner", "missing", "CALLS")],
    )
    folder = str(tmp_path / "store")
    sinks.write_graph(g, folder)
    back = sinks.read_graph(spark, folder)
    assert back.nodes.count() == 3 and got(back.edges, "kind") == [("CONTAINS",), ("CONTAINS",)]
    sinks.replace_project(type(g)(g.of_kind("MODULE"), g.edges), folder, "app", spark)
    back = sinks.read_graph(spark, folder)
    assert got(back.nodes, "kind") == [("MODULE",)] and back.edges.count() == 0


def test_neighbourhood_hash(make_graph):
    import hashlib

    g = make_graph([node("a", "FUNCTION"), node("b", "FUNCTION")], [("a", "b", "CALLS"), ("c", "b", "CALLS"), ("b", "a", "CALLS")])
    want = hashlib.sha256(b"2:1:a,a,c").hexdigest()
    assert dict(got(views.neighbourhood_hashes(g), "fqn", "graph_hash"))["b"] == want


def test_materialize_reads_the_session_folder(spark, tmp_path):
    df = materialize(spark.range(3), "x")
    assert df.count() == 3 and "graphlens" in df.inputFiles()[0]
