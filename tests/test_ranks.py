"""Ranks in a fixed number of iterations against plain Python, with rings, ends and repeated edges."""

import random

import pytest

from graphlens.operators import community


def by_hand(nodes, edges, iterations, damping=0.85):
    out = {n: {b for a, b in edges if a == n} for n in nodes}
    rank = {n: 1 / len(nodes) for n in nodes}
    for _ in range(iterations):
        lost = sum(r for n, r in rank.items() if not out[n])
        new = {n: (1 - damping) / len(nodes) + damping * lost / len(nodes) for n in nodes}
        for n, r in rank.items():
            for b in out[n]:
                new[b] += damping * r / len(out[n])
        rank = new
    return rank


@pytest.mark.parametrize("shape", ["rings", "levels"])
def test_ranks_after_four_iterations(make_graph, monkeypatch, shape):
    random.seed(5)
    names = [f"n{i}" for i in range(9)]
    pairs = [(random.choice(names), random.choice(names)) for _ in range(14)] if shape == "rings" else [("n0", "n1"), ("n0", "n1"), ("n1", "n2"), ("n3", "n2")]
    graph = make_graph([{"fqn": n, "kind": "FUNCTION"} for n in names], [(a, b, "CALLS") for a, b in pairs] + [("n0", "elsewhere", "CALLS")])
    rounds = []
    store = community.materialize
    monkeypatch.setattr(community, "materialize", lambda df, label="step": rounds.append(label) or store(df, label))
    found = {r.fqn: r.pagerank for r in community.pagerank(graph, ["CALLS"], 4).collect()}
    assert found == pytest.approx(by_hand(names, pairs, 4), abs=1e-12)
    if shape == "levels":  # walks end after two edges: no later round is made
        assert rounds.count("arrived") == 3
