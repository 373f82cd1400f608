"""SQL table functions against the operators that answer the same questions."""

import pytest

from graphlens.operators import traverse
from graphlens.operators.adjacency import store_graph
from graphlens.operators.questions import register_questions


@pytest.fixture(scope="module")
def graph(make_graph):
    nodes = [{"fqn": f, "kind": k, "name": n} for f, k, n in (
        ("m", "MODULE", "m"), ("m.A", "CLASS", "A"), ("m.A.f", "FUNCTION", "f"), ("m.B.g", "FUNCTION", "g"), ("m.C.h", "FUNCTION", "h"), ("t", "TABLE", "t"), ("x", "TRANSACTION", "GET /x"), ("lone", "CLASS", "Lone"))]
    edges = [("m", "m.A", "CONTAINS"), ("m.A", "m.A.f", "CONTAINS"), ("m.A.f", "m.B.g", "CALLS"), ("m.A.f", "m.B.g", "CALLS"), ("m.B.g", "m.C.h", "CALLS"), ("m.C.h", "m.A.f", "CALLS"), ("m.B.g", "t", "WRITES"), ("x", "m.A.f", "INCLUDES"), ("x", "m.B.g", "INCLUDES")]
    plain = make_graph(nodes, edges)
    stored = store_graph(plain)
    register_questions(stored)
    return plain, stored


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_search_and_details(spark, graph):
    assert rows(spark.sql("SELECT fqn, type FROM graph_search('a')")) == [("m.A", "Class"), ("m.A.f", "Function")]
    assert rows(spark.sql("SELECT fqn FROM graph_search('a', 'Class')")) == [("m.A",)]
    assert rows(spark.sql("SELECT role, fqn FROM graph_details('m.B.g')")) == [("callee", "m.C.h"), ("caller", "m.A.f"), ("node", "m.B.g")]


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_impact(spark, graph, depth):
    seeds = graph[0].nodes.filter("fqn = 'm.A'").select("fqn")
    down = traverse.impact_downstream(graph[0], seeds, depth).filter("node <> seed").select("node", "depth")
    assert rows(spark.sql(f"SELECT fqn, depth FROM graph_impact('m.A', most => {depth})")) == rows(down)
    up = {r[0] for r in spark.sql(f"SELECT fqn FROM graph_impact('m.A', 'upstream', {depth})").collect()}
    assert up == {1: {"m.C.h"}, 2: {"m.C.h", "m.B.g"}, 5: {"m.C.h", "m.B.g", "m.A.f"}}[depth]


def test_path_and_transaction(spark, graph):
    assert rows(spark.sql("SELECT * FROM graph_path('m.C.h', 't')")) == [(0, "m.C.h", "h", "Function", 2), (1, "m.B.g", "g", "Function", 2), (2, "t", "t", "Table", 2)]
    assert rows(spark.sql("SELECT part, fqn, target FROM graph_transaction('GET /x')")) == [("edge", "m.A.f", "m.B.g"), ("node", "m.A.f", None), ("node", "m.B.g", None)]


@pytest.mark.parametrize("question", ["graph_details('?')", "graph_impact('?')", "graph_path('m.A', 'lone')", "graph_path('?', 't')", "graph_transaction('?')", "graph_search('?')"])
def test_unknown_names_give_no_rows(spark, graph, question):
    assert spark.sql(f"SELECT * FROM {question}").count() == 0


def test_arguments_reach_the_scans(spark, graph):
    text = spark.sql("SELECT * FROM graph_impact('m.A', most => 1)")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(src,m.A)" in text and text.count("Scan parquet") == 4  # two scans, each named twice
