"""Louvain communities and ranks against plain Python."""

import random

import numpy as np
import pytest

from graphlens.operators import community
from graphlens.operators.community import class_links, connected_communities, louvain, modularity, pagerank_within


def score(edges, member):
    """Modularity of undirected unit links."""
    m2, inside, totals = 2 * len(edges), 0, {}
    for a, b in edges:
        inside += 2 * (member[a] == member[b])
        for end in (a, b):
            totals[member[end]] = totals.get(member[end], 0) + 1
    return inside / m2 - sum(t * t for t in totals.values()) / m2**2


def reachable(start, allowed, edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    seen, todo = {start}, [start]
    while todo:
        for n in near.get(todo.pop(), []):
            if n in allowed and n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def check(graph, names, edges):
    member = {r["fqn"]: r["community"] for r in louvain(graph, 1e-12).collect()}
    assert set(member) == set(names)
    for community in set(member.values()):
        inside = {n for n in names if member[n] == community}
        assert min(inside) == community
        assert reachable(community, inside, edges) == inside
    return member


def test_planted_cliques(make_graph):
    names = [f"c{i}{j}" for i in range(4) for j in range(5)] + ["lonely"]
    edges = [(f"c{i}{a}", f"c{i}{b}") for i in range(4) for a in range(5) for b in range(a)] + [(f"c{i}0", f"c{(i + 1) % 4}0") for i in range(4)]
    graph = make_graph([{"fqn": n, "kind": "CLASS"} for n in names], [(a, b, "DEPENDS_ON") for a, b in edges])
    member = check(graph, names, edges)
    assert member == {n: f"{n[:2]}0" if n != "lonely" else n for n in names}


def test_random_graph_beats_singletons(spark, make_graph):
    rng = random.Random(5)
    names = [f"n{i:02}" for i in range(40)]
    edges = sorted({tuple(sorted(rng.sample(names, 2))) for _ in range(90)})
    graph = make_graph([{"fqn": n, "kind": "CLASS"} for n in names], [(a, b, "CALLS") for a, b in edges])
    member = check(graph, names, edges)
    assert score(edges, member) > max(0.25, score(edges, {n: n for n in names}))
    links = spark.createDataFrame([(a, b, 1.0) for a, b in edges] + [(b, a, 1.0) for a, b in edges], "a string, b string, w double")
    rows = spark.createDataFrame(list(member.items()), "node string, community string")
    assert modularity(links, rows) == pytest.approx(score(edges, member))


def test_followers_are_not_looked_at_again(make_graph, monkeypatch):
    rows = {}

    def watched(df, label="step", write=community.materialize):
        table = write(df, label)
        rows[label] = max(rows.get(label, 0), table.count())
        return table

    monkeypatch.setattr(community, "materialize", watched)
    names = [f"h{i}" for i in range(3)] + [f"h{i}.{j}" for i in range(3) for j in range(12)] + ["a0", "a1", "lonely"]
    edges = [(f"h{i}.{j}", f"h{i}") for i in range(3) for j in range(12)] + [("h0", "h1"), ("a0", "a1")]
    graph = make_graph([{"fqn": n, "kind": "CLASS"} for n in names], [(a, b, "DEPENDS_ON") for a, b in edges])
    member = check(graph, names, edges)
    assert {member[f"h{i}"] for i in range(3)} == {"h0", "h1", "h2"} and member["a1"] == "a0"
    # Three hubs, a pair and a lonely class stand for all 42.
    assert rows["labels"] == rows["hooked"] == rows["level"] == 5


def test_links_count_from_both_ends(make_graph):
    edges = [("a", "b", "CALLS"), ("b", "a", "DEPENDS_ON"), ("a", "b", "CALLS"), ("c", "c", "CALLS"), (None, "c", "CALLS"), ("c", "x", "CALLS")]
    graph = make_graph([{"fqn": n, "kind": "CLASS"} for n in "abc"], edges)
    assert sorted(map(tuple, class_links(graph).collect())) == [("a", "b", 3.0), ("b", "a", 3.0), ("c", "c", 2.0)]


def test_communities_of_graphs_without_links(make_graph):
    graph = make_graph([{"fqn": n, "kind": "CLASS"} for n in "ab"], [])
    assert sorted(map(tuple, louvain(graph).collect())) == [("a", "a"), ("b", "b")]
    assert louvain(make_graph([], [])).count() == 0


def test_disconnected_communities_are_split(spark):
    path = [(f"p{i:03}", f"p{i + 1:03}") for i in range(64)] + [("x", "y")]
    links = spark.createDataFrame([(a, b, 1.0) for a, b in path] + [(b, a, 1.0) for a, b in path], "a string, b string, w double")
    names = sorted({n for pair in path for n in pair})
    members = spark.createDataFrame([(n, "one") for n in names] + [("alone", "one")], "node string, community string")
    out = dict(map(tuple, connected_communities(links, members).collect()))
    assert out == {n: "p000" if n[0] == "p" else "x" if n in "xy" else n for n in [*names, "alone"]}


def dense(names, edges, damping=0.85):
    n, at = len(names), {x: i for i, x in enumerate(names)}
    step = np.full((n, n), 0.0)
    for a in names:
        outs = {d for s, d in edges if s == a}
        for d in outs or names:
            step[at[d], at[a]] += 1 / len(outs or names)
    return np.linalg.solve(np.eye(n) - damping * step, np.full(n, (1 - damping) / n))


@pytest.mark.parametrize("bound", [1e-2, 1e-7])
def test_pagerank_error_stays_within_its_bound(make_graph, bound):
    rng = random.Random(8)
    names = [f"n{i}" for i in range(25)]
    edges = [tuple(rng.choices(names[:20], k=1) + rng.choices(names, k=1)) for _ in range(70)]
    graph = make_graph([{"fqn": n, "kind": "FUNCTION"} for n in names], [(a, b, "CALLS") for a, b in edges])
    ranks = {r["fqn"]: r["pagerank"] for r in pagerank_within(graph, ["CALLS"], bound).collect()}
    exact = dense(names, set(edges))
    assert abs(sum(ranks.values()) - 1) < 1e-9
    assert sum(abs(ranks[n] - x) for n, x in zip(names, exact)) <= bound


def test_pagerank_without_edges(make_graph):
    graph = make_graph([{"fqn": n, "kind": "FUNCTION"} for n in "abcd"], [])
    assert {r["pagerank"] for r in pagerank_within(graph, ["CALLS"]).collect()} == {0.25}
    assert pagerank_within(make_graph([], []), ["CALLS"]).count() == 0
