"""Walks with seeds as bits against plain searches, and what they store."""

import random

from graphlens.operators import change, traverse
from graphlens.operators import seed_sets as seed_sets_module
from graphlens.operators.seed_sets import seed_sets, walk


def _levels(hops, starts, most):
    """Node to least number of steps, at least one, from any start; a start counts if a way leads back."""
    found, front = {}, set(starts)
    for depth in range(1, most + 1):
        front = {b for a, b in hops if a in front} - found.keys()
        found |= dict.fromkeys(front, depth)
    return found


def test_a_walk_from_more_seeds_than_a_block_has(spark):
    rng = random.Random(3)
    hops = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)}
    seeds = [(f"s{i}", f"n{rng.randrange(60)}") for i in range(150)] + [(None, "n1")]
    table = spark.createDataFrame(sorted(hops), "a string, b string")
    sets = seed_sets(spark.createDataFrame(seeds, "seed string, node string"))
    for again in (False, True):
        wanted = set()
        for seed in {s for s, _ in seeds}:
            starts = {n for s, n in seeds if s == seed}
            wanted |= {(seed, n, d) for n, d in _levels(hops, starts, 4).items() if again or n not in starts}
        assert {tuple(r) for r in walk(table, sets, 4, again=again).spread().select("seed", "node", "depth").collect()} == wanted


def test_requests_are_walked_together(spark, make_graph):
    names = ["m", "m.A", "m.A.f", "m.A.g", "m.B", "m.B.f", "m.B.g", "m.C", "m.C.f", "t"]
    contains = [(n.rpartition(".")[0], n, "CONTAINS") for n in names if "." in n]
    rng = random.Random(8)
    for _ in range(2):
        calls = [(rng.choice(names), rng.choice(names), rng.choice(["CALLS", "DEPENDS_ON", "READS"])) for _ in range(9)]
        graph = make_graph([{"fqn": n, "kind": "FUNCTION"} for n in names], contains + calls)
        touched = {(f"pr{i}", rng.choice(names)) for i in range(40) for _ in range(i % 3 + 1)}
        wanted = set()
        for pr in {p for p, _ in touched}:
            own = {f for p, f in touched if p == pr}
            down = _levels({(s, d) for s, d, k in contains + calls if k in traverse.DOWNSTREAM}, own, 5)
            wanted |= {(pr, n, d, "downstream") for n, d in down.items() if n not in own}
            for f in own:
                inside = {f, *_levels({(s, d) for s, d, k in contains + calls if k == "CONTAINS"}, [f], 10)}
                up = _levels({(d, s) for s, d, k in contains + calls if k in traverse.UPSTREAM}, inside, 5)
                wanted |= {(pr, n, 1, "upstream") for n in up if n not in own and not n.startswith(f + ".")}
        changed = spark.createDataFrame(sorted(touched), "pr_id string, fqn string")
        sets = change.impact_sets(graph, changed)
        rows = [tuple(r) for r in sets.spread("pr_id").select("pr_id", "fqn", "depth", "side").collect()]
        assert len(rows) == len(set(rows)) and set(rows) == wanted
        # One row per node, side and depth, however many requests there are.
        assert sets.rows.count() <= len(names) * 6 < len(rows) * 2
        unique = {(r["pr_id"], r["fqn"]): r["depth"] for r in change.unique_affected(sets).spread("pr_id").collect()}
        plain = {(r["pr_id"], r["fqn"]): r["depth"] for r in change.unique_affected(sets.spread("pr_id")).collect()}
        assert unique == plain and len(unique) == len({r[:2] for r in rows})


def test_a_walk_stops_at_nodes_that_no_hop_leaves(spark, monkeypatch):
    written = []
    monkeypatch.setattr(seed_sets_module, "materialize", lambda df, label="step", real=seed_sets_module.materialize: written.append(label) or real(df, label))
    hops = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "a string, b string")
    sets = seed_sets(spark.createDataFrame([("a", "a"), ("b", "b")], "seed string, node string"))
    found = walk(hops, sets, 5).spread().select("seed", "node", "depth").collect()
    assert sorted(map(tuple, found)) == [("a", "x", 1), ("b", "x", 1), ("b", "y", 1)]
    assert written.count("reach") == 1


def test_sets_of_any_size_name_their_seeds(spark):
    rng = random.Random(4)
    starts = seed_sets(spark.createDataFrame([(f"s{i:02}", "n") for i in range(64)], "seed string, node string"))
    chosen = [sorted(rng.sample(range(64), k)) for k in (1, 2, 3, 4, 9, 64)] + [[63], [0], [0, 63], [0, 31, 63], [61, 62, 63]]
    bits = [(0, i, sum(1 << b for b in c) - (1 << 64 if 63 in c else 0)) for i, c in enumerate(chosen)]
    rows = starts.with_rows(spark.createDataFrame(bits, "block long, i int, bits long")).spread().collect()
    assert sorted((r["i"], r["seed"]) for r in rows) == [(i, f"s{b:02}") for i, c in enumerate(chosen) for b in c]
