"""One question loads no buckets: the graph's tables are read as they are, or the edges of the question once."""

import os

import pytest

from graphlens.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_a_question_stores_no_bucketed_edges(spark):
    before = {t.name for t in spark.catalog.listTables() if t.name.startswith("graph_edges_by_")}
    assert catalog.QUERIES["ext4_search"](spark, FOLDER).columns == ["fqn", "name", "type", "path"]
    rows = catalog.QUERIES["ext4_impact"](spark, FOLDER).collect()
    assert {r["depth"] for r in rows} <= {1, 2, 3} and rows
    assert {t.name for t in spark.catalog.listTables() if t.name.startswith("graph_edges_by_")} == before
