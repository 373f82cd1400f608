"""Nodes with one neighbour follow it before the first sweep."""

from graphlens.operators import community


def test_stars_need_no_sweep(make_graph, monkeypatch):
    names = [f"h{i}" for i in range(3)] + [f"a{i}{j}" for i in range(3) for j in range(8)] + ["x", "y", "z"]
    edges = [(f"a{i}{j}", f"h{i}", "DEPENDS_ON") for i in range(3) for j in range(8)] + [("y", "x", "CALLS"), ("z", "z", "CALLS")]
    swept = []
    level = community._level
    monkeypatch.setattr(community, "_level", lambda *args: swept.append(args) or level(*args))
    graph = make_graph([{"fqn": n, "kind": "CLASS"} for n in names], edges)
    found = dict(map(tuple, community.louvain(graph, 1e-12).collect()))
    assert found == {**{f"a{i}{j}": f"a{i}0" for i in range(3) for j in range(8)}, **{f"h{i}": f"a{i}0" for i in range(3)}, "x": "x", "y": "x", "z": "z"}
    assert not swept
