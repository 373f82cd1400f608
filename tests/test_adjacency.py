"""Walks over a stored graph give what walks over plain edges give, and open only what they meet."""

import random

import pytest

from graphlens.operators import adjacency, traverse
from graphlens.operators.adjacency import Hops, store_graph

KINDS = ["CALLS", "CONTAINS", "WRITES", "READS", "INJECTS", "IMPLEMENTS", "RENDERS"]


@pytest.fixture(scope="module")
def graphs(make_graph):
    rng = random.Random(2)
    nodes = [{"fqn": f"m{k % 9}.n{k}", "kind": rng.choice(["CLASS", "FUNCTION", "TABLE"])} for k in range(120)]
    names = [n["fqn"] for n in nodes]
    edges = [(rng.choice(names), rng.choice(names), rng.choice(KINDS)) for _ in range(260)]
    plain = make_graph(nodes, edges)
    return plain, store_graph(plain)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("few", [adjacency.FEW, 0])
def test_walks_agree(spark, graphs, monkeypatch, few):
    """Also where every frontier is too large for a list."""
    monkeypatch.setattr(adjacency, "FEW", few)
    plain, stored = graphs
    seeds = plain.nodes.select("fqn").limit(7)
    for walk in (
        lambda g: traverse.impact(g, seeds, "both", 4), lambda g: traverse.impact_downstream(g, seeds, 3), lambda g: traverse.impact_upstream(g, seeds, 3),
        lambda g: traverse.impact_graph_export(g, seeds, "upstream", 2), lambda g: traverse.neighbourhood(g, seeds, 2),
    ):
        assert rows(walk(stored)) == rows(walk(plain))


def test_a_hop_opens_the_buckets_and_kinds_of_its_frontier(spark, graphs):
    _, stored = graphs
    frontier = stored.nodes.limit(1).selectExpr("fqn AS node").cache()
    for direction, key in (("out", "src"), ("in", "dst")):
        hops = Hops(stored, ("CALLS",), direction).near(frontier)
        text = hops._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "Bucketed: " in text and f"PushedFilters: [EqualTo({key}," in text.replace(f"IsNotNull({key}), ", "") and "(kind" in text and "Exchange" not in text


def test_a_walk_writes_no_edges(spark, graphs, monkeypatch):
    written = []
    monkeypatch.setattr(traverse, "materialize", lambda df, label="step", real=traverse.materialize: written.append(label) or real(df, label))
    traverse.impact(graphs[1], graphs[0].nodes.select("fqn").limit(1), "both", 3).collect()
    assert set(written) == {"reach"}


def test_dropped_graphs_leave_the_catalogue(spark, graphs):
    again = store_graph(graphs[0])
    again.drop()
    assert not spark.catalog.tableExists(again.by_src) and spark.catalog.tableExists(graphs[1].by_src)
