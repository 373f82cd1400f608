"""Skew-safe building blocks against brute force."""

import random
from fnmatch import fnmatchcase

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphlens.functions.scale import first_by, last_by, numbered, overlap_join, with_next
from graphlens.operators import link, traverse
from graphlens.operators.change import merge_runs
from graphlens.streaming.rollups import suppress_batch


def test_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert sorted(map(tuple, first_by(df, ["k"], ["o"], ["v"]).collect())) == [("a", "y"), ("b", "z")]
    assert sorted(map(tuple, last_by(df, ["k"], ["o"], ["v"]).collect())) == [("a", "x"), ("b", "z")]


def test_numbered_hot_and_null_groups(spark):
    random.seed(1)
    rows = [("hot", i) for i in random.sample(range(5000), 3000)] + [(f"k{i % 50}", i) for i in range(200)] + [(None, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    out = numbered(df, ["k"], ["v"], "n").collect()
    assert len(out) == len(rows)
    for key in {r[0] for r in rows}:
        values = sorted(v for k, v in rows if k == key)
        assert {r["v"]: r["n"] for r in out if r["k"] == key} == {v: i for i, v in enumerate(values)}


def test_with_next(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "k string, pos int, v string")
    assert sorted(map(tuple, with_next(df, ["k"], "pos", {"v": "nxt"}).select("v", "nxt").collect())) == [("x", "y"), ("y", None)]


def test_overlap_join_is_exact(spark):
    random.seed(2)

    def spans(n):
        out = []
        for i in range(n):
            start = random.randint(0, 3000)
            out.append(("hot" if random.random() < 0.7 else "cold", i, start, start + random.choice([0, 1, 7, 40, 900, 3000]) - (1 if random.random() < 0.05 else 0)))
        return out

    left, right = spans(150), spans(150)
    a = spark.createDataFrame(left, "k string, i int, s int, e int")
    b = spark.createDataFrame(right, "k string, j int, s2 int, e2 int")
    got = sorted((r["i"], r["j"]) for r in overlap_join(a, b, ["k"], ("s", "e"), ("s2", "e2")).collect())
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] <= y[3] and x[3] >= y[2] and x[3] >= x[2] and y[3] >= y[2])
    assert got == want


def test_glob_matches_are_exact(spark):
    random.seed(3)
    words = ["order", "pay", "user", "x", "created", "a.b", "[z]"]
    names = [".".join(random.choices(words, k=random.randint(1, 3))) for _ in range(80)]
    patterns = ["order.*", "*", "?", "*.created", "*pay*", "user.?", "[ou]*.x", "[!o]*", "a.b*x", "x", "order.created?"]
    got = sorted(map(tuple, link.glob_matches(
        spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    ).collect()))
    assert got == sorted({(n, p) for n in names for p in patterns if fnmatchcase(n, p)})


def test_parameter_matches_are_exact(spark):
    random.seed(4)

    def paths(n):
        return sorted({"/" + "/".join(random.choice(["a", "b", "c", ":param"]) for _ in range(random.randint(1, 3))) for _ in range(n)})

    calls, ends = paths(40), paths(15)
    random.shuffle(ends)
    index = spark.createDataFrame([("GET", p, f"e{i}", i) for i, p in enumerate(ends)], "method string, path string, endpoint string, ord int")
    wanted = spark.createDataFrame([("GET", p) for p in calls], "method string, path string")

    def first(call):
        parts = call.strip("/").split("/")
        for i, end in enumerate(ends):
            other = end.strip("/").split("/")
            if len(parts) == len(other) and all(x == y or ":param" in (x, y) for x, y in zip(parts, other)):
                return f"e{i}"

    got = {r["path"]: r["endpoint"] for r in link.parameter_matches(wanted, index).collect()}
    assert got == {c: first(c) for c in calls if first(c)}


def merge_one_by_one(counts, target):
    batches = [(size, [(size, rank)]) for size in sorted(counts) for rank in range(counts[size])]
    while len(batches) > target and len(batches) > 1:
        batches.sort(key=lambda b: b[0])
        a, b = batches.pop(0), batches.pop(0)
        batches.append((a[0] + b[0], a[1] + b[1]))
    return sorted(sorted(items) for _size, items in batches)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 5), st.integers(0, 40)), st.integers(1, 8))
def test_merging_runs_equals_merging_one_by_one(counts, target):
    fast = [sorted((size, rank) for size, lo, hi in group for rank in range(lo, hi)) for group in merge_runs(counts, target)]
    assert sorted(fast) == merge_one_by_one(counts, target)


def test_impact_grows_with_depth_and_matches_breadth_first(spark, make_graph):
    random.seed(5)
    names = [f"n{i}" for i in range(25)]
    edges = [(random.choice(names), random.choice(names), "CALLS") for _ in range(45)]
    g = make_graph([{"fqn": n, "kind": "FUNCTION"} for n in names], edges)
    seeds = spark.createDataFrame([(n,) for n in names[:5]], "fqn string")

    def brute(seed, limit):
        depth, front, seen = 0, {seed}, {seed}
        out = {}
        while front and depth < limit:
            depth += 1
            front = {b for a, b, _ in edges if a in front} - seen
            seen |= front
            out.update({n: depth for n in front})
        return out

    deep = {}
    for limit in (2, 4):
        found = {}
        for r in traverse.impact_downstream(g, seeds, limit).collect():
            found.setdefault(r["seed"], {})[r["node"]] = r["depth"]
        for seed in names[:5]:
            assert found.get(seed, {}) == brute(seed, limit)
        for seed, reached in deep.items():
            assert set(reached) <= set(found[seed])
        deep = found


def test_suppression_keeps_one_per_day(spark):
    rows = [("s", "t", f"2024-01-01 0{h}:00:00") for h in range(3)] + [("s", "t", "2024-01-02 00:00:00"), ("s", "t", "2024-01-02 00:00:01"), ("s", "u", "2024-01-01 05:00:00")]
    df = spark.createDataFrame(rows, "subject string, trigger string, sent_at string").selectExpr("subject", "trigger", "CAST(sent_at AS TIMESTAMP) AS sent_at")
    out = sorted((r["trigger"], str(r["sent_at"])) for r in suppress_batch(df).collect())
    assert out == [("t", "2024-01-01 00:00:00"), ("t", "2024-01-02 00:00:01"), ("u", "2024-01-01 05:00:00")]
