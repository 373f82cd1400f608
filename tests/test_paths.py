"""Shortest paths against a plain search, and what the search stores."""

import random
from collections import deque

from graphlens.operators import traverse


def test_the_last_hop_of_a_path_is_not_opened(spark, make_graph, monkeypatch):
    stored = []

    def watched(df, label="step", write=traverse.materialize):
        table = write(df, label)
        if label in ("head", "tail"):
            stored.append(table.count())
        return table

    monkeypatch.setattr(traverse, "materialize", watched)
    edges = [("from", f"mid{i}", "CALLS") for i in range(20)] + [(f"mid{i}", f"leaf{i}.{j}", "CALLS") for i in range(20) for j in range(30)]
    edges += [("mid7", "last", "READS"), ("mid9", "last", "READS"), ("last", "to", "CALLS"), ("lone", "to", "CALLS")]
    graph = make_graph([{"fqn": n, "kind": "FUNCTION"} for n in {e[i] for e in edges for i in (0, 1)}], edges)
    path = traverse.shortest_paths(graph, spark.createDataFrame([("from", "to")], "from_fqn string, to_fqn string"), 3)
    assert [r["node"] for r in path.orderBy("position").collect()] == ["from", "mid7", "last", "to"]
    assert max(stored) <= 20


def test_lengths_and_smallest_steps(spark, make_graph):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", "CALLS") for _ in range(60)]
    links = {}
    for a, b, _ in edges:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(40)]
    graph = make_graph([{"fqn": f"n{i}", "kind": "FUNCTION"} for i in range(40)], edges)
    for most in (3, 4):
        rows = traverse.shortest_paths(graph, spark.createDataFrame(pairs, "from_fqn string, to_fqn string"), most).collect()
        paths = {}
        for r in sorted(rows, key=lambda r: r["position"]):
            paths.setdefault((r["from_fqn"], r["to_fqn"]), []).append(r["node"])
        for a, b in set(pairs):
            far, queue = {a: 0}, deque([a])
            while queue:
                node = queue.popleft()
                for other in links.get(node, ()):
                    if other not in far:
                        far[other] = far[node] + 1
                        queue.append(other)
            if far.get(b, most + 1) > most:
                assert (a, b) not in paths
            else:
                way = paths[a, b]
                assert len(way) == far[b] + 1 and way[0] == a and way[-1] == b and all(y in links[x] for x, y in zip(way, way[1:]))


def test_goals_that_no_open_pair_can_reach_open_no_hops(spark, make_graph, monkeypatch):
    """One pair meets at its first goal; the other is in two parts of the graph that share nothing."""
    stored = {}

    def watched(df, label="step", write=traverse.materialize):
        table = write(df, label)
        stored.setdefault(label, []).append(table.count())
        return table

    monkeypatch.setattr(traverse, "materialize", watched)
    edges = [("a", f"x{i}", "CALLS") for i in range(9)] + [(f"x{i}", f"g{j}", "CALLS") for i in range(9) for j in range(9)] + [(f"g{j}", "t", "CALLS") for j in range(9)]
    edges += [("b", f"y{i}", "CALLS") for i in range(9)]
    graph = make_graph([{"fqn": n, "kind": "FUNCTION"} for n in {e[i] for e in edges for i in (0, 1)}], edges)
    rows = traverse.shortest_paths(graph, spark.createDataFrame([("a", "t"), ("b", "t")], "from_fqn string, to_fqn string"), 3).collect()
    assert [(r["from_fqn"], r["node"]) for r in sorted(rows, key=lambda r: r["position"])] == [("a", "a"), ("a", "x0"), ("a", "g0"), ("a", "t")]
    assert stored["beyond"] and set(stored["beyond"]) == {0}
