"""New dependencies, file search and report cadence on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphlens.functions.text import path_glob_regex
from graphlens.operators import change, usage


def test_new_module_dependencies(spark, make_graph):
    nodes = [{"fqn": m, "kind": "MODULE"} for m in "abc"] + [{"fqn": f"{m}.{k}", "kind": "CLASS"} for m in "abc" for k in "xy"]
    edges = [(m, f"{m}.{k}", "CONTAINS") for m in "abc" for k in "xy"]
    edges += [("a.x", "b.x", "CALLS"), ("a.x", "c.x", "INJECTS"), ("b.y", "a.y", "DEPENDS_ON"), ("a.x", "a.y", "CALLS"), ("a", "b", "IMPORTS")]
    graph = make_graph(nodes, edges)
    changed = spark.createDataFrame([("1", "a.x"), ("1", "b.y"), ("2", "b.x"), ("3", "b.y")], "pr_id string, fqn string")
    found = change.new_module_dependencies(graph, change.containing_modules(graph), changed)
    assert sorted(map(tuple, found.collect())) == [("1", "a", "c"), ("1", "b", "a"), ("3", "b", "a")]


@pytest.mark.parametrize("pattern, path, hit", [
    ("**/*.py", "a.py", True), ("**/*.py", "x/y/a.py", True), ("src/*.py", "src/x/a.py", False), ("src/*.py", "src/a.py", True), ("src/**", "src/x/a.py", True),
    ("s?c/[ab].t.t", "src/a.t.t", True), ("s?c/[!ab].py", "src/a.py", False), ("a.b", "axb", False), ("*/x", "a/b/x", False), ("**/t/*", "t/a", True), ("a+(b)/*", "a+(b)/c", True),
])
def test_path_globs(spark, pattern, path, hit):
    assert spark.range(1).select(F.lit(path).rlike(path_glob_regex(pattern))).first()[0] is hit


def test_reports_are_due_in_their_hour(spark):
    configs = spark.createDataFrame([(1, True, "monthly", 31, 8), (2, True, "weekly", 0, 8), (3, False, "weekly", 0, 8), (4, True, "off", 0, 8), (5, True, "weekly", 6, 23)], "id int, enabled boolean, cadence string, day int, hour int")
    hours = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=k),) for k in range(24 * 60)]
    found = usage.due_reports(configs, spark.createDataFrame(hours, "at timestamp")).selectExpr("id", "date_format(at, 'MM-dd HH')").collect()
    by = {i: [t for j, t in found if j == i] for i in range(1, 6)}
    assert by[1] == ["01-31 08"] and sorted(by[2])[:2] == ["01-01 08", "01-08 08"] and len(by[2]) == 9 and not by[3] and not by[4] and sorted(by[5])[0] == "01-07 23"
