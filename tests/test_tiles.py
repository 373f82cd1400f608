"""Answers that hold every pair of a key: whole, each pair once, and never shuffled."""

from graphlens.functions.scale import tiled_join
from graphlens.operators.rules import injection, mapping


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_a_tiled_join_has_every_pair_once(spark):
    left = [("a", f"l{i}") for i in range(23)] + [("b", "l0"), ("b", "l0"), (None, "l1"), ("c", "l2")]
    right = [("a", f"r{i}") for i in range(17)] + [("b", "r0"), (None, "r1"), ("d", "r2")]
    met = tiled_join(spark.createDataFrame(left, "k string, l string"), spark.createDataFrame(right, "k string, r string"), ["k"], "l", "r", side=4)
    assert got(met, "k", "l", "r") == sorted((k, x, y) for k, x in left for q, y in right if k is not None and k == q)


def _beans(make_graph):
    """``S`` and ``T`` ask for two interfaces; B0 and B1 implement both, B2 the first, B3 the second."""
    beans = [{"fqn": f"B{i}", "kind": "CLASS", "annotations": ["Service"]} for i in range(4)]
    asked = [
        {"fqn": f"{owner}.f{i}", "kind": "FIELD", "annotations": ["Autowired"], "type": kind, "annotation_args": label}
        for owner, of in (("S", ((1, "I", None), (2, "J", None), (3, "J", {"Qualifier": "x"}))), ("T", ((1, "J", None),))) for i, kind, label in of
    ]
    owners = [{"fqn": x, "kind": "CLASS", "annotations": ["Controller"]} for x in "ST"]
    links = [("B0", "I"), ("B1", "I"), ("B2", "I"), ("B0", "J"), ("B1", "J"), ("B3", "J")]
    return make_graph(
        [*beans, *owners, {"fqn": "I", "kind": "INTERFACE"}, {"fqn": "J", "kind": "INTERFACE"}, *asked],
        [(a, b, "IMPLEMENTS") for a, b in links] + [(f["fqn"][0], f["fqn"], "CONTAINS") for f in asked],
    )


def test_a_candidate_of_two_types_is_listed_once(make_graph):
    graph = _beans(make_graph)
    named = [("S", b, None) for b in ("B0", "B1", "B2", "B3")] + [("S", b, "x") for b in ("B0", "B1", "B3")] + [("T", b, None) for b in ("B0", "B1", "B3")]
    rows = injection.bean_injections(graph).selectExpr("src", "dst", "props['Qualifier'] AS never", "props['qualifier'] AS q").collect()
    assert sorted((r.src, r.dst, str(r.q)) for r in rows) == sorted((s, b, str(q)) for s, b, q in named)
    assert got(injection.bean_injections(graph, qualifiers=False), "src", "dst") == sorted({(s, b) for s, b, _ in named})


def _after_the_last_join(df):
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    return tree.split("Join")[0]


def test_pairs_are_the_answer_and_are_not_shuffled(spark, make_graph):
    fields = [{"fqn": f"M.f{i}", "name": "f", "kind": "FIELD", "type": "int"} for i in range(3)]
    columns = [{"fqn": f"t{i}.f", "name": "f", "kind": "COLUMN", "type": "BIGINT"} for i in range(2)]
    graph = make_graph([{"fqn": "M", "kind": "CLASS"}, *fields, *columns], [("M", "pydantic.BaseModel", "INHERITS")] + [("M", f["fqn"], "CONTAINS") for f in fields])
    pairs = mapping.field_columns(graph)
    assert got(pairs, "src", "dst", "confidence") == sorted((f["fqn"], c["fqn"], 1) for f in fields for c in columns)
    for answer in (pairs, injection.bean_injections(_beans(make_graph), qualifiers=False).filter("confidence = 1")):
        above = _after_the_last_join(answer)
        assert "Aggregate" not in above and "Repartition" not in above
        assert answer._jdf.queryExecution().optimizedPlan().toString().count("_row") > 0
