"""Catalogue queries against DuckDB; GRAPHLENS_FULL=1 runs every one of them."""

import os

import pytest

from graphlens.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "agg1_class_fan_metrics", "agg20_activity_stats", "agg27_neighbourhood_hash", "fn_usage_cost", "flt14_file_category", "g1_impact_downstream", "g7_class_cycles", "jn6_http_parameter_links",
    "jn7_topic_edges", "jn11_changed_nodes", "jn17_using_dependencies", "jn31_repositories", "jn33_annotated_endpoints", "snk2_stored_edges", "src7_dependencies", "str3_activity_per_day", "win10_schema_history",
]
NAMES = sorted(catalog.QUERIES) if os.environ.get("GRAPHLENS_FULL") else SAMPLE
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    return str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLES:
        return
    cursor = duck.execute(catalog.ORACLES[name])
    order = [c[0] for c in cursor.description]
    assert sorted(order) == columns
    assert rows == sorted(tuple(plain(r[order.index(c)]) for c in columns) for r in cursor.fetchall())


def test_every_oracle_has_its_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
