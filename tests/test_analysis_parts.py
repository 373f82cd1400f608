"""Parts of a pull request analysis are worked out when they are asked for; sets are counted before they become pairs."""

from collections import Counter

from graphlens.operators import change
from graphlens.operators.seed_sets import seed_sets


def test_sets_are_counted_before_they_are_spread(spark, monkeypatch):
    starts = seed_sets(spark.createDataFrame([(f"p{i:02}", "n") for i in range(70)], "seed string, node string"))
    # 500 nodes that five requests of the first block share, 20 of one more request and 30 of a request of the second block.
    rows = [(0, 0b11111, "a")] * 500 + [(0, 1 << 9, "b")] * 20 + [(1, 1, "a")] * 30
    sets = starts.with_rows(spark.createDataFrame(rows, "block long, bits long, kind string"))
    spread, seen = type(sets).spread, []
    monkeypatch.setattr(type(sets), "spread", lambda self, *a: seen.append(self.rows.count()) or spread(self, *a))
    found = {(r["pr_id"], r["kind"]): r["n"] for r in sets.counted("pr_id", "n", "kind").collect()}
    assert found == {**{(f"p{i:02}", "a"): 500 for i in range(5)}, ("p09", "b"): 20, ("p64", "a"): 30}
    assert seen == [3]


def test_sizes_ask_for_no_other_part(spark, make_graph, monkeypatch):
    nodes = [{"fqn": n, "kind": "FUNCTION", "path": "a.py", "line": 10 * i, "end_line": 10 * i + 5} for i, n in enumerate("fgh")] + [{"fqn": "t", "kind": "TABLE"}]
    graph = make_graph(nodes, [("f", "g", "CALLS"), ("g", "t", "READS"), ("h", "f", "CALLS")])
    changed = spark.createDataFrame([("1", "f"), ("2", "g"), ("2", "h"), ("2", "h")], "pr_id string, fqn string")
    monkeypatch.setattr(change, "map_diffs", lambda graph, diffs: (changed, None))
    for name in ("cross_technology_impacts", "drift_report", "risk_report"):
        monkeypatch.setattr(change, name, lambda *a: 1 / 0)
    parts = change.analyse_pull_requests(graph, None)
    assert sorted(map(tuple, parts["sizes"].select("pr_id", "changed_nodes", "blast_radius").collect())) == [("1", 1, 3), ("2", 2, 2)]
    assert Counter(r["pr_id"] for r in parts["affected"].collect()) == {"1": 3, "2": 2}
