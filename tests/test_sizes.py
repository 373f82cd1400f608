"""Tables in small files that unfold in memory are not sent whole to the driver."""

from pyspark.sql import functions as F

from graphlens.functions.scale import materialize
from graphlens.operators import resolve


def test_a_table_of_many_sorted_names_is_not_broadcast(spark):
    found = spark.range(1_000_000).select(F.lit("r:0").alias("seed"), F.concat(F.lit("c:"), F.col("id").cast("string")).alias("node"))
    stored = materialize(found, "frontier")
    other = materialize(found.withColumnRenamed("seed", "other"), "frontier")
    plan = stored.join(other, "node")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_renames_alone_read_no_edges(spark, make_graph):
    graph = make_graph([{"fqn": "F", "kind": "CLASS", "path": "a.java", "line": 3}], [])

    class Unread:
        nodes = graph.nodes

        @property
        def edges(self):
            raise AssertionError("edges are not needed for renames")

    rows = spark.createDataFrame([("semanticdb maven . . com/n/F#", "a.java", 2, 1, 1)], "symbol string, relative_path string, start_line int, roles int, seq long")
    assert [tuple(r) for r in resolve.symbol_renames(Unread(), rows)[1].select("fqn", "scip_fqn").collect()] == [("F", "com.n.F")]


def test_a_union_of_tables_spread_alike_is_spread_anew(spark):
    """Spark joined the partitions of such a union end to end: "Can't zip RDDs with unequal numbers of partitions: List(48, 16)"."""
    table = materialize(spark.range(100).select((F.col("id") % 7).alias("k"), "id"))
    sides = [table.filter(f"id % 3 = {i}").groupBy("k").agg(F.max("id").alias("id")) for i in range(3)]
    union = sides[0].unionByName(sides[1]).unionByName(sides[2])
    plan = union.groupBy("k").agg(F.max("id"))._jdf.queryExecution().executedPlan().toString()
    above, _ = plan.split("Union", 1)
    assert "Exchange" in above
