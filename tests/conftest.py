import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("graphlens-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_graph(spark):
    """Graph from short rows: nodes as dicts, edges as (src, dst, kind[, more])."""
    from pyspark.sql import types as T

    from graphlens.graph import Graph
    from graphlens.schema import EDGE_SCHEMA, HIGH, NODE_SCHEMA

    def rows(values, schema):
        return spark.createDataFrame([tuple(v.get(f.name) for f in schema.fields) for v in values], T.StructType(schema.fields))

    def build(nodes, edges):
        n = [{"app_name": "app", "seq": i, "name": v["fqn"].split(".")[-1], **v} for i, v in enumerate(nodes)]
        e = []
        for i, (src, dst, kind, *more) in enumerate(edges):
            e.append({"app_name": "app", "src": src, "dst": dst, "kind": kind, "confidence": HIGH, "evidence": "test", "seq": i, **(more[0] if more else {})})
        return Graph(rows(n, NODE_SCHEMA), rows(e, EDGE_SCHEMA))

    return build
