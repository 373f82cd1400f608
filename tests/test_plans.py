"""Plans stay free of the shapes that do not scale."""

import os

import pytest

from graphlens.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")

PLAIN = [
    "agg1_class_fan_metrics", "agg2_class_depends_on", "agg3_module_imports", "jn18_virtual_dispatch", "jn37_dead_functions", "jn5_http_exact_links", "jn6_http_parameter_links",
    "jn7_topic_edges", "jn9_hunk_overlap", "jn21_constructor_injection", "jn28_field_columns", "win10_schema_history", "agg22_billable_loc", "flt14_file_category", "src7_dependencies",
]


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", PLAIN)
def test_no_cross_products_and_no_python(spark, name):
    text = plan(catalog.QUERIES[name](spark, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text, f"{name} has {bad}"


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalog.QUERIES["flt10_layer_rules"](spark, FOLDER))
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in text
    text = plan(catalog.QUERIES["flt17_pull_request_page"](spark, FOLDER))
    assert "PushedFilters: [" in text and "EqualTo(o_custkey,7)" in text


def test_a_kind_filter_drops_whole_branches(spark):
    from graphlens.plans.derived import shop_graph

    text = plan(shop_graph(spark, FOLDER).edges_of("WRITES").select("src", "dst"))
    assert text.count("Scan parquet") <= 2 and "orders.parquet" not in text


def test_first_wins_combines_before_the_shuffle(spark):
    text = plan(catalog.QUERIES["win2_latest_run"](spark, FOLDER))
    assert "partial_max_by" in text and "Window" not in text


@pytest.mark.parametrize("name", ["jn15_call_resolution", "jn17_using_dependencies", "agg3_module_imports", "agg7_class_edges", "agg18_component_links", "jn39_transaction_edges"])
def test_shared_inputs_are_computed_once(spark, name):
    tree = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert tree.count("FileScan") < 20 and "NestedLoop" not in tree
