"""Walks over a graph that is asked once load no buckets and write its edges once."""

from graphlens.operators import traverse
from graphlens.plans import catalog, traverse_queries


def test_edges_are_written_once(make_graph, spark, monkeypatch):
    graph = make_graph([{"fqn": n, "kind": "MODULE"} for n in "abcd"], [("a", "b", "CALLS"), ("b", "c", "READS"), ("d", "b", "CALLS")])
    seeds, written, store = spark.createDataFrame([("a",)], "fqn string"), [], traverse.materialize
    monkeypatch.setattr(traverse, "materialize", lambda df, label="step": written.append(label) or store(df, label))
    found = traverse.impact_graph_export(graph, seeds, "downstream", 2)
    assert sorted(map(tuple, found.select("seed", "node", "depth").collect())) == [("a", "b", 1), ("a", "c", 2)]
    assert sorted(r.node for r in traverse.neighbourhood(graph, seeds, 2).collect()) == ["b", "c", "d"]
    assert written == ["edges", "edges"]


def test_impact_queries_do_not_store_the_graph(spark, monkeypatch):
    def stored(*_):
        raise AssertionError("loads the whole graph into buckets")

    monkeypatch.setattr(traverse_queries, "stored_shop_graph", stored)
    for name in ("g2_impact_upstream", "g5_k_hop_neighbours"):
        assert not catalog.QUERIES[name](spark, "/root/testdata/sf0.001").isEmpty()
