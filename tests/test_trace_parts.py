"""Parts of a trace that are asked for alone are the same as in the whole trace."""

import random

from graphlens.operators import traverse


def got(df, *cols):
    return sorted(tuple(str(v) for v in r) for r in df.select(*cols).collect())


def test_nodes_and_access_alone_equal_the_whole_trace(make_graph, spark, monkeypatch):
    random.seed(3)
    names = [f"n{i}" for i in range(12)]
    nodes = [{"fqn": n, "kind": "TABLE" if i > 9 else "FUNCTION"} for i, n in enumerate(names)]
    edges = [(random.choice(names), random.choice(names), k) for k in ("CALLS", "READS", "WRITES", "IMPLEMENTS") for _ in range(5)]
    graph, seeds = make_graph(nodes, edges), spark.createDataFrame([("n0",), ("n3",), ("n7",)], "fqn string")
    whole, links = traverse.trace_route(graph, seeds, 3)
    columns = ["seed", "direction", "node", "name", "kind", "depth", "layer", "sequence"]
    assert got(whole, *columns)
    written = []
    store = traverse.edges_within
    monkeypatch.setattr(traverse, "edges_within", lambda members, edges, *names: written.append(edges) or store(members, edges, *names))
    assert got(traverse.trace_nodes(graph, seeds, 3), *columns) == got(whole, *columns)
    access = got(links.filter("type IN ('READS', 'WRITES')"), "seed", "source", "target", "type")
    assert got(traverse.trace_access(graph, seeds, 3), "seed", "source", "target", "type") == access
    # Calls inside the trace say nothing about its nodes and are not sought.
    assert all(e.filter("type = 'CALLS'").isEmpty() for e in written)


def test_traces_are_stored_as_sets(make_graph, spark, monkeypatch):
    starts = [f"s{i}" for i in range(40)]
    nodes = [{"fqn": n, "kind": "FUNCTION"} for n in [*starts, *"abcde"]] + [{"fqn": "t", "kind": "TABLE"}]
    edges = [(s, n, "CALLS") for s in starts for n in "abcde"] + [("a", "t", "READS"), ("b", "c", "IMPLEMENTS")]
    rows = {}

    def watched(df, label="step", write=traverse.materialize):
        table = write(df, label)
        rows[label] = max(rows.get(label, 0), table.count())
        return table

    monkeypatch.setattr(traverse, "materialize", watched)
    graph, seeds = make_graph(nodes, edges), spark.createDataFrame([(s,) for s in starts], "fqn string")
    shown, links = traverse.trace_route(graph, seeds, 3)
    # b is hidden behind c; a reads.
    assert got(shown.filter("seed = 's7'"), "node", "layer", "sequence") == [("a", "repository", "1"), ("c", "other", "2"), ("d", "other", "3"), ("e", "other", "4"), ("t", "database", "5")]
    assert links.count() == 40 * 5 and shown.count() == 40 * 5
    assert rows["trace"] == 6 and rows["inner"] <= len(edges)
