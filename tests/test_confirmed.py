"""Confirmed edges alone are those of the whole merge, and the graph's edges are read only for calls to what is no function."""

from graphlens.graph import Graph
from graphlens.operators import resolve

PREFIX = "semanticdb maven . . "


def _index(spark, callees):
    rows = [(f"{PREFIX}com/n/F#run().", "./a.java", 1, 1, 1)] + [(f"{PREFIX}{c}", "a.java", 5, 8, i) for i, c in enumerate([*callees, *callees])]
    occurrences = spark.createDataFrame(rows, "symbol string, relative_path string, start_line int, roles int, seq long")
    info = spark.createDataFrame(
        [(f"{PREFIX}K", ["text"], [(f"{PREFIX}I", True), (f"{PREFIX}gone", True)])],
        "symbol string, documentation array<string>, relationships array<struct<symbol: string, is_implementation: boolean>>",
    )
    return occurrences, info


def _graph(make_graph):
    nodes = [{"fqn": "run", "kind": "FUNCTION", "path": "a.java", "line": 1, "end_line": 9}, {"fqn": "g", "kind": "FUNCTION"}]
    nodes += [{"fqn": n, "kind": "CLASS"} for n in ("K", "I", "L")]
    return make_graph(nodes, [("run", "K", "CALLS"), ("run", "K", "CALLS", {"seq": 90}), ("run", "g", "CALLS"), ("K", "I", "IMPLEMENTS"), ("run", "L", "READS")])


def test_confirmed_edges_equal_the_merge(spark, make_graph):
    graph = _graph(make_graph)
    # g is a function, K is called already, L and what is unknown are not.
    index = _index(spark, ["g", "K", "L", "unknown"])
    merged = resolve.merge_symbols(graph, *index)[0].edges.filter("evidence = 'scip'").select("src", "dst", "kind").distinct()
    found = sorted(map(tuple, resolve.confirmed_edges(graph, *index).select("src", "dst", "kind").collect()))
    assert found == sorted(map(tuple, merged.collect())) == [("K", "I", "IMPLEMENTS"), ("com.n.F.run", "K", "CALLS"), ("com.n.F.run", "g", "CALLS")]


def test_calls_to_functions_read_no_edges(spark, make_graph):
    graph = _graph(make_graph)

    class Unread(Graph):
        def edges_of(self, *kinds):
            raise AssertionError("edges are not needed")

    found = resolve.confirmed_edges(Unread(graph.nodes, graph.edges), *_index(spark, ["g"]))
    assert sorted(map(tuple, found.collect())) == [("K", "I", "IMPLEMENTS"), ("com.n.F.run", "g", "CALLS")]
