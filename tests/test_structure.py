"""Chains, strong components, closed trails, edges inside groups and digest trees against plain versions."""

import hashlib
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from graphlens.operators import structure, traverse, views


def test_chains_double_and_end_in_rings(spark):
    line = [(f"n{i:04}", f"n{i + 1:04}") for i in range(1000)] + [("a", "b"), ("b", "c"), ("c", "b"), ("x", "x")]
    parents = spark.createDataFrame(line, "child string, parent string")
    seeds = spark.createDataFrame([("n0000",), ("n0990",), ("a",), ("x",), ("alone",)], "seed string")
    found = {(s, n): up for s, n, up in map(tuple, structure.chains(parents, seeds).collect())}
    up = dict(line)
    want = {}
    for seed in ("n0000", "n0990", "a", "x", "alone"):
        node, k = seed, 0
        while node is not None and (seed, node) not in want:
            want[(seed, node)] = k
            node, k = up.get(node), k + 1
    assert found == want and len(want) > 1000


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    real = structure.materialize
    monkeypatch.setattr(structure, "materialize", lambda df, label: written.append(label) or real(df, label))
    parents = spark.range(2_000).selectExpr("cast(id AS string) AS child", "cast(id + 1 AS string) AS parent")
    assert structure.chains(parents, spark.createDataFrame([("0",)], "seed string")).count() == 2_001
    assert written.count("chain") <= 13


def _edges(seed, nodes, n):
    rng = random.Random(seed)
    return sorted({(f"v{rng.randrange(nodes)}", f"v{rng.randrange(nodes)}") for _ in range(n)})


def _closure(edges):
    reach = set(edges)
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            return reach
        reach |= more


@pytest.mark.parametrize("seed, nodes, n", [(1, 9, 13), (2, 14, 18), (3, 5, 9)])
def test_strong_components(spark, seed, nodes, n):
    edges = _edges(seed, nodes, n)
    reach = _closure([e for e in edges if e[0] != e[1]])
    want = {}
    for a in {x for e in edges for x in e}:
        group = {a} | {b for b in {x for e in edges for x in e} if (a, b) in reach and (b, a) in reach}
        if len(group) > 1:
            want[a] = min(group)
    found = structure.strong_components(spark.createDataFrame(edges, "src string, dst string"))
    assert dict(map(tuple, found.collect())) == want


def test_no_component_in_a_graph_without_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c")], "src string, dst string")
    assert structure.strong_components(edges).isEmpty() and structure.strong_components(edges.limit(0)).isEmpty()


def _trails(edges, low, high, starts=None):
    found, walks = set(), [((a, b), (i,)) for a, b, i in edges if starts is None or a in starts]
    for length in range(1, high + 1):
        found |= {(w, length) for w, _ in walks if w[0] == w[-1] and length >= low}
        walks = [((*w, b), (*used, i)) for w, used in walks for a, b, i in edges if a == w[-1] and i not in used]
    return found


#: Two rings that share a node, a parallel edge, a loop and a way back.
RING = [("I", "v0", "v1"), ("I", "v1", "v2"), ("I", "v2", "v0"), ("J", "v0", "v1"), ("I", "v2", "v3"), ("I", "v3", "v2"), ("I", "v3", "v3"), ("J", "v3", "v3"), ("I", "v4", "v5"), ("I", "v5", "v4")]


@pytest.mark.parametrize("high, starts", [(4, None), (5, None), (5, {"v0", "v3"}), (6, {"v1"})])
def test_closed_trails(spark, high, starts):
    rows = [(a, b, f"{k}{a}{b}") for k, a, b in RING] + [("v9", "v0", "in"), ("v0", "v8", "out")]
    edges = spark.createDataFrame(rows, "src string, dst string, edge_id string")
    given = None if starts is None else spark.createDataFrame([(s,) for s in sorted(starts)], "fqn string")
    found = [(tuple(c), n) for c, n in map(tuple, traverse.closed_trails(edges, 2, high, given).collect())]
    want = _trails(rows, 2, high, starts)
    assert want and len(found) == len(set(found)) and set(found) == want


def test_edges_within_groups(spark):
    rng = random.Random(7)
    members = {(f"g{rng.randrange(6)}", f"v{rng.randrange(12)}") for _ in range(40)} | {(f"g{k}", "v0") for k in range(6)}
    edges = [(a, b, k) for k, (a, b) in product("IJ", _edges(8, 12, 30))]
    want = sorted((g, a, b, k) for a, b, k in edges for g in {g for g, _ in members} if (g, a) in members and (g, b) in members)
    found = structure.edges_within(spark.createDataFrame(sorted(members), "grp string, node string"), spark.createDataFrame(edges, "src string, dst string, kind string"), "grp")
    assert sorted(map(tuple, found.select("grp", "src", "dst", "kind").collect())) == want


@pytest.mark.parametrize("size", [2, 3, 100])
def test_digest_tree(spark, size):
    items = {("hub", 0): [f"i{k:02}" for k in range(20)] + ["i03"], ("hub", 1): ["z"], ("leaf", 0): ["b", "a"]}
    rows = [(key, part, item) for (key, part), held in items.items() for item in held]

    def text(entries):
        runs = [",".join(entries[k : k + size]) for k in range(0, len(entries), size)]
        return runs[0] if len(runs) == 1 else text([hashlib.sha256(r.encode()).hexdigest() for r in runs])

    found = views.range_texts(spark.createDataFrame(rows, "key string, part int, item string"), size)
    assert {(k, p): t for k, p, t in map(tuple, found.collect())} == {k: text(sorted(v)) for k, v in items.items()}


def test_digests_need_no_python(make_graph):
    graph = make_graph([], [("a", "b", "CALLS")])
    assert "InPandas" not in views.neighbourhood_hashes(graph)._jdf.queryExecution().toString()


def test_cycle_count(make_graph):
    nodes = [{"fqn": m, "kind": "MODULE"} for m in "abc"]
    graph = make_graph(nodes, [("a", "b", "IMPORTS"), ("b", "a", "IMPORTS"), ("b", "c", "IMPORTS"), ("a", "b", "CALLS")])
    assert traverse.cycle_count(graph).select(F.col("circular_dependency_count")).first()[0] == 2
