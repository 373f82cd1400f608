"""Graph views over the driver tables, with the same views as SQL for the oracle.

The views scale with the tables: every lineitem becomes a call and a data access.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.graph import Graph, edge_rows, node_rows
from graphlens.operators.adjacency import StoredGraph, store_graph
from graphlens.plans.registry import table

APP = "shop"


def key(prefix: str, col: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(col).cast("string"))


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def shop_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Regions as modules, nations as classes, customers and suppliers as functions."""

    def rows(name: str, *columns: str) -> DataFrame:
        return node_rows(table(spark, d, name).selectExpr(f"'{APP}' AS app_name", *columns))

    modules = rows("region", "concat('r:', r_regionkey) AS fqn", "r_name AS name", "'MODULE' AS kind")
    classes = rows(
        "nation", "concat('n:', n_nationkey) AS fqn", "n_name AS name", "'CLASS' AS kind",
        "element_at(array('java', 'python', 'csharp'), n_nationkey % 3 + 1) AS language",
        "concat('nation:', n_nationkey) AS path", "1 AS line", "99999 AS end_line", "n_nationkey * 10 AS loc",
        "CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey * 7 % 11 END AS complexity",
        "CASE WHEN n_nationkey % 5 <> 0 THEN element_at(array('Presentation', 'Business Logic', 'Data Access'), "
        "n_nationkey % 3 + 1) END AS layer",
        "CASE WHEN n_nationkey % 2 = 0 THEN element_at(array('spring-boot', 'django', 'efcore'), n_nationkey % 3 + 1) END "
        "AS framework",
    )
    callers = rows(
        "customer", "concat('c:', c_custkey) AS fqn", "c_name AS name", "'FUNCTION' AS kind",
        "lower(c_mktsegment) AS language", "concat('nation:', c_nationkey) AS path",
        "c_custkey % 1000 * 10 + 1 AS line", "c_custkey % 1000 * 10 + 8 AS end_line", "floor(abs(c_acctbal)) AS loc",
        "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN array('Scheduled') WHEN 'BUILDING' THEN array('Service', 'Bean') END "
        "AS annotations",
        "CASE WHEN c_custkey % 10 = 0 THEN true END AS is_constructor",
    )
    callees = rows(
        "supplier", "concat('s:', s_suppkey) AS fqn", "s_name AS name", "'FUNCTION' AS kind", "'sql' AS language",
        "concat('nation:', s_nationkey) AS path", "s_suppkey % 1000 * 10 + 5 AS line", "s_suppkey % 1000 * 10 + 9 AS end_line",
        "floor(abs(s_acctbal)) AS loc",
    )
    tables = rows("part", "concat('p:', p_partkey) AS fqn", "p_name AS name", "'TABLE' AS kind", "p_size AS loc")
    flows = rows("orders", "concat('o:', o_orderkey) AS fqn", "concat('order ', o_orderkey) AS name", "'TRANSACTION' AS kind")
    return _stack([modules, classes, callers, callees, tables, flows])


def shop_edges(spark: SparkSession, d: str) -> DataFrame:
    """Containment, one call and one data access per lineitem, order membership."""

    def rows(df: DataFrame, src: str, dst: str, kind: str, *more: str) -> DataFrame:
        return edge_rows(df.selectExpr(f"'{APP}' AS app_name", f"{src} AS src", f"{dst} AS dst", f"{kind} AS kind", *more))

    nation, line = table(spark, d, "nation"), table(spark, d, "lineitem")
    seq = "l_orderkey * 10 + l_linenumber AS seq"
    calls = line.join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
    return _stack([
        rows(nation, "concat('r:', n_regionkey)", "concat('n:', n_nationkey)", "'CONTAINS'"),
        rows(table(spark, d, "customer"), "concat('n:', c_nationkey)", "concat('c:', c_custkey)", "'CONTAINS'"),
        rows(table(spark, d, "supplier"), "concat('n:', s_nationkey)", "concat('s:', s_suppkey)", "'CONTAINS'"),
        rows(calls, "concat('c:', o_custkey)", "concat('s:', l_suppkey)", "'CALLS'", seq),
        # The two access kinds stay separate branches, so a filter on kind drops a branch.
        rows(line.filter("l_linestatus = 'O'"), "concat('s:', l_suppkey)", "concat('p:', l_partkey)", "'READS'", seq),
        rows(line.filter("l_linestatus <> 'O'"), "concat('s:', l_suppkey)", "concat('p:', l_partkey)", "'WRITES'", seq),
        rows(line, "concat('o:', l_orderkey)", "concat('s:', l_suppkey)", "'INCLUDES'", seq),
        rows(nation.filter("n_nationkey % 5 = 0"), "concat('n:', n_nationkey)", "concat('n:', (n_nationkey + 1) % 25)", "'DEPENDS_ON'"),
        rows(nation, "concat('n:', n_nationkey)", "concat('n:', (n_nationkey * 3 + 1) % 25)", "'INJECTS'"),
        rows(nation.filter("n_nationkey = 0"), "'r:0'", "'r:1'", "'IMPORTS'"),
    ])


def shop_graph(spark: SparkSession, d: str) -> Graph:
    return Graph(shop_nodes(spark, d), shop_edges(spark, d))


def nation_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Nation-to-nation dependencies, all of them.

    Lines are counted per (customer, supplier) before the nations are joined, so
    the wide input shrinks ahead of the second shuffle.
    """
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    pairs = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("lines"))
    )
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("a"))
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("b"))
    weights = (
        pairs.join(customer, "o_custkey").join(supplier, "l_suppkey").filter("a <> b")
        .groupBy("a", "b").agg(F.sum("lines").alias("weight"))
    )
    edges = weights.select(key("n", "a").alias("src"), key("n", "b").alias("dst"), F.lit("DEPENDS_ON").alias("kind"), "weight")
    return edge_rows(edges).withColumn("app_name", F.lit(APP))


# The same views for the oracle. ------------------------------------------------------------

SHOP_NODES = """g_nodes AS MATERIALIZED (
  SELECT 'r:' || r_regionkey AS fqn, r_name AS name, 'MODULE' AS kind, NULL::VARCHAR AS language, NULL::VARCHAR AS path,
         NULL::INTEGER AS line, NULL::INTEGER AS end_line, NULL::INTEGER AS loc, NULL::INTEGER AS complexity,
         NULL::VARCHAR AS layer, NULL::VARCHAR AS framework, NULL::VARCHAR[] AS annotations, NULL::BOOLEAN AS is_constructor
  FROM region
  UNION ALL
  SELECT 'n:' || n_nationkey, n_name, 'CLASS',
         CASE n_nationkey % 3 WHEN 0 THEN 'java' WHEN 1 THEN 'python' ELSE 'csharp' END, 'nation:' || n_nationkey,
         1, 99999, n_nationkey * 10, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey * 7 % 11 END,
         CASE WHEN n_nationkey % 5 <> 0 THEN
           CASE n_nationkey % 3 WHEN 0 THEN 'Presentation' WHEN 1 THEN 'Business Logic' ELSE 'Data Access' END END,
         CASE WHEN n_nationkey % 2 = 0 THEN
           CASE n_nationkey % 3 WHEN 0 THEN 'spring-boot' WHEN 1 THEN 'django' ELSE 'efcore' END END,
         NULL, NULL
  FROM nation
  UNION ALL
  SELECT 'c:' || c_custkey, c_name, 'FUNCTION', lower(c_mktsegment), 'nation:' || c_nationkey,
         CAST(c_custkey % 1000 * 10 + 1 AS INTEGER), CAST(c_custkey % 1000 * 10 + 8 AS INTEGER),
         CAST(floor(abs(c_acctbal)) AS INTEGER), NULL, NULL, NULL,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ['Scheduled'] WHEN 'BUILDING' THEN ['Service', 'Bean'] END,
         CASE WHEN c_custkey % 10 = 0 THEN TRUE END
  FROM customer
  UNION ALL
  SELECT 's:' || s_suppkey, s_name, 'FUNCTION', 'sql', 'nation:' || s_nationkey,
         CAST(s_suppkey % 1000 * 10 + 5 AS INTEGER), CAST(s_suppkey % 1000 * 10 + 9 AS INTEGER),
         CAST(floor(abs(s_acctbal)) AS INTEGER), NULL, NULL, NULL, NULL, NULL
  FROM supplier
  UNION ALL
  SELECT 'p:' || p_partkey, p_name, 'TABLE', NULL, NULL, NULL, NULL, p_size, NULL, NULL, NULL, NULL, NULL FROM part
  UNION ALL
  SELECT 'o:' || o_orderkey, 'order ' || o_orderkey, 'TRANSACTION', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM orders)"""

SHOP_EDGES = """g_edges AS MATERIALIZED (
  SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst, 'CONTAINS' AS kind, NULL::BIGINT AS weight, NULL::BIGINT AS seq FROM nation
  UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'CONTAINS', NULL, NULL FROM customer
  UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'CONTAINS', NULL, NULL FROM supplier
  UNION ALL SELECT 'c:' || o_custkey, 's:' || l_suppkey, 'CALLS', NULL, l_orderkey * 10 + l_linenumber
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 's:' || l_suppkey, 'p:' || l_partkey, CASE WHEN l_linestatus = 'O' THEN 'READS' ELSE 'WRITES' END, NULL,
    l_orderkey * 10 + l_linenumber FROM lineitem
  UNION ALL SELECT 'o:' || l_orderkey, 's:' || l_suppkey, 'INCLUDES', NULL, l_orderkey * 10 + l_linenumber FROM lineitem
  UNION ALL SELECT 'n:' || n_nationkey, 'n:' || ((n_nationkey + 1) % 25), 'DEPENDS_ON', NULL, NULL FROM nation WHERE n_nationkey % 5 = 0
  UNION ALL SELECT 'n:' || n_nationkey, 'n:' || ((n_nationkey * 3 + 1) % 25), 'INJECTS', NULL, NULL FROM nation
  UNION ALL SELECT 'r:0', 'r:1', 'IMPORTS', NULL, NULL FROM nation WHERE n_nationkey = 0)"""

SHOP = SHOP_NODES + ",\n" + SHOP_EDGES

NATION_DEP = """dep AS MATERIALIZED (
  SELECT 'n:' || a AS src, 'n:' || b AS dst, weight FROM (
    SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN supplier ON l_suppkey = s_suppkey
    WHERE c_nationkey <> s_nationkey GROUP BY 1, 2))"""


_STORED: dict[tuple[str, str], StoredGraph] = {}


def stored_shop_graph(spark: SparkSession, d: str) -> StoredGraph:
    """The shop graph, stored once per application and folder: loaded first, asked often."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        _STORED[key] = store_graph(shop_graph(spark, d))
    return _STORED[key]
