"""Calls go down the ladder once, and the tables behind the code graph are joined once."""

import os

import pytest

from graphlens.operators import resolve
from graphlens.plans import catalog, resolve_queries
from graphlens.schema import LOW

FOLDER = "/root/testdata/sf0.001"
driver_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")


def tree(df):
    return df._jdf.queryExecution().executedPlan().toString()


@driver_tables
def test_lines_are_joined_once_for_the_code_graph(spark):
    graph = resolve_queries.code_graph(spark, FOLDER)
    for side in (graph.nodes, graph.edges):
        assert "lineitem.parquet" not in tree(side)


@driver_tables
def test_rungs_are_not_shuffled_to_be_compared(spark):
    assert tree(catalog.QUERIES["jn15_call_resolution"](spark, FOLDER)).count("Exchange hashpartitioning") <= 2


@driver_tables
def test_types_are_not_shuffled_by_every_name_that_a_class_tries(spark):
    text = tree(catalog.QUERIES["jn17_using_dependencies"](spark, FOLDER))
    assert "hashpartitioning(fqn" not in text


def calls(make_graph, edges):
    nodes = [
        {"fqn": "a.K", "kind": "CLASS", "usings": ["b"]}, {"fqn": "a.K.run", "kind": "FUNCTION"}, {"fqn": "a.L", "kind": "CLASS"},
        {"fqn": "b.T", "kind": "CLASS"}, {"fqn": "b.T.go", "kind": "FUNCTION"}, {"fqn": "c.T", "kind": "CLASS"}, {"fqn": "c.T.go", "kind": "FUNCTION"},
        {"fqn": "c.U", "kind": "MODULE"}, {"fqn": "c.U.go", "kind": "FUNCTION"}, {"fqn": "b.V", "kind": "MODULE"}, {"fqn": "b.V.go", "kind": "FUNCTION"},
        {"fqn": "a.K.f", "kind": "FIELD", "type": "T<x>", "seq": 50}, {"fqn": "a.L.f", "kind": "FIELD", "type": "U", "seq": 60},
        {"fqn": "a.K.other", "name": "h", "kind": "FIELD", "type": "U", "seq": 70},
    ]
    return resolve.resolve_calls(make_graph(nodes, [("a.K", "a.K.run", "CONTAINS"), ("a.K", "a.K.f", "CONTAINS"), ("a.K", "a.K.other", "CONTAINS"), *edges]))


def low(target):
    return ("a.K.run", target, "CALLS", {"confidence": LOW})


def found(df):
    return sorted((r.dst, r.resolved, r.rung) for r in df.collect())


def test_every_rung(make_graph):
    asked = ["f.go", "h.go", "T.go", "T.T", "V.go", "V.V", "go", "other", "f.none", "h"]
    assert found(calls(make_graph, [low(t) for t in asked])) == [
        ("T.T", "b.T", 3), ("T.go", "b.T.go", 1), ("V.V", "b.V", 5), ("V.go", "b.V.go", 4), ("f.go", "b.T.go", 2), ("h", "a.K.other", 6), ("h.go", "c.U.go", 2),
    ]


def test_the_last_field_of_a_name_wins_wherever_it_is_declared(make_graph):
    # a.L.f is contained in a.K too, and later: its type is the field's
    assert found(calls(make_graph, [low("f.go"), ("a.K", "a.L.f", "CONTAINS")])) == [("f.go", "c.U.go", 2)]
    # its last container is another class: the class's own field stays
    assert found(calls(make_graph, [low("f.go"), ("a.K", "a.L.f", "CONTAINS"), ("a.L", "a.L.f", "CONTAINS")])) == [("f.go", "b.T.go", 2)]


def test_an_import_beats_the_ladder(make_graph):
    assert found(calls(make_graph, [low("T.go"), low("go"), ("a.K", "c", "IMPORTS"), ("a.K", "c.U", "IMPORTS")])) == [("T.go", "b.T.go", 1), ("go", "c.U.go", 0)]
