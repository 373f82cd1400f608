"""Tables of many flows that share their members."""

from graphlens.operators import traverse


def test_an_access_is_followed_once_for_flows_that_share_it(make_graph, spark, monkeypatch):
    nodes = [{"fqn": f"f{i}", "kind": "FUNCTION"} for i in range(3)] + [{"fqn": t, "kind": "TABLE"} for t in ("t0", "t1")] + [{"fqn": "v", "kind": "VIEW"}]
    graph = make_graph(nodes, [("f0", "t0", "READS"), ("f0", "t0", "WRITES"), ("f1", "t0", "READS"), ("f1", "t1", "WRITES"), ("f2", "v", "READS")])
    flows = {f"e{i}": ["f0", "f1"] if i % 2 else ["f0", "f2"] for i in range(70)}
    members = spark.createDataFrame([(e, f) for e, fs in flows.items() for f in fs], "entry string, node string")
    sets = []
    store = traverse.seed_sets
    monkeypatch.setattr(traverse, "seed_sets", lambda pairs: sets.append(store(pairs)) or sets[-1])
    found = sorted(map(tuple, traverse.flow_tables(graph, members).collect()))
    assert found == sorted((e, t) for e, fs in flows.items() for t in ("t0", "t1") if t == "t0" or "f1" in fs)
    # 70 flows are two blocks of three members at most, not 140 pairs.
    assert sets[0].rows.count() <= 6
