"""Scalar functions and the SQL views over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.functions import text
from graphlens.operators import tools
from graphlens.plans.derived import SHOP_EDGES, shop_graph
from graphlens.plans.registry import query, table


@query(
    "fn_patch_hunks",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_linenumber * 10 AS INTEGER) AS old_start, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE l_quantity END AS INTEGER) AS old_count,
      CAST(l_linenumber * 11 AS INTEGER) AS new_start, CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE l_quantity END AS INTEGER) AS new_count FROM lineitem""",
)
def _(spark, d):
    patch = (
        "concat('diff', char(10), '@@ -', l_linenumber * 10, CASE WHEN l_returnflag = 'R' THEN '' ELSE concat(',', CAST(l_quantity AS INT)) END, ' +', l_linenumber * 11, "
        "CASE WHEN l_linestatus = 'O' THEN '' ELSE concat(',', CAST(l_quantity AS INT)) END, ' @@ def f', char(10), '+x')"
    )
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{patch} AS patch")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.explode(text.patch_hunks(F.col("patch"))).alias("h")).select("l_orderkey", "l_linenumber", "l_partkey", "h.*")


@query(
    "fn_entity_table_name",
    "SELECT p_partkey, 'line_' || CASE p_type WHEN 'PROMO' THEN 'boxes' WHEN 'SMALL' THEN 'cities' WHEN 'LARGE' THEN 'boys' ELSE 'items' END AS table_name FROM part",
)
def _(spark, d):
    name = F.expr("concat('Line', CASE p_type WHEN 'PROMO' THEN 'Box' WHEN 'SMALL' THEN 'City' WHEN 'LARGE' THEN 'Boy' ELSE 'Item' END)")
    return table(spark, d, "part").select("p_partkey", text.entity_table_name(name).alias("table_name"))


@query(
    "fn_transaction_name",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'GET /n' || c_nationkey || ' -> m' || c_custkey WHEN 'FURNITURE' THEN 'MSG ? -> m' || c_custkey
      WHEN 'MACHINERY' THEN 'SCHED 5 * -> m' || c_custkey ELSE 'TXN -> a.b.m' || c_custkey END AS name FROM customer""",
)
def _(spark, d):
    kind = F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN 'http_endpoint' WHEN 'FURNITURE' THEN 'message_consumer' WHEN 'MACHINERY' THEN 'scheduled' ELSE 'main' END")
    metadata = F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN map('method', 'GET', 'path', concat('/n', c_nationkey)) WHEN 'MACHINERY' THEN map('cron', '5 *') ELSE map('x', 'y') END")
    fqn = F.expr("concat('a.b.m', c_custkey)")
    return table(spark, d, "customer").select("c_custkey", text.transaction_name(kind, fqn, metadata).alias("name"))


@query(
    "fn_path_joins",
    """SELECT c_custkey, '/n' || c_nationkey || '/c' || c_custkey AS joined, '/a/b' || c_custkey AS collapsed, '/api/user/:id/m' || c_custkey AS routed FROM customer""",
)
def _(spark, d):
    rows = table(spark, d, "customer")
    prefix = F.expr("concat('/n', c_nationkey, CASE WHEN c_acctbal > 0 THEN '/' ELSE '' END)")
    path = F.expr("concat(CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE '/' END, 'c', c_custkey)")
    route = text.combine_route(text.controller_route(F.lit("api/[controller]"), F.lit("UserController")), F.lit("{id:int}/[action]"), F.expr("concat('M', c_custkey)"))
    return rows.select(
        "c_custkey", text.join_paths(prefix, path).alias("joined"), text.collapse_slashes(F.expr("concat('a//b', c_custkey)")).alias("collapsed"), route.alias("routed")
    )


@query(
    "fn_flyway_name",
    "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_suppkey || '.' || s_nationkey END AS version, CASE WHEN s_acctbal > 0 THEN 'add_x' END AS description FROM supplier",
)
def _(spark, d):
    name = F.expr("concat(CASE WHEN s_acctbal > 0 THEN 'V' ELSE 'U' END, s_suppkey, '.', s_nationkey, '__add_x.sql')")
    return table(spark, d, "supplier").select("s_suppkey", text.flyway_version(name).alias("version"), text.flyway_description(name).alias("description"))


@query("fn_generic_types", "SELECT p_partkey, 'Map,String,T' || p_size AS types FROM part")
def _(spark, d):
    wrapped = F.expr("concat('Map<String, T', p_size, '<X>>')")
    return table(spark, d, "part").select("p_partkey", F.array_join(text.bare_types(wrapped), ",").alias("types"))


@query("ext4_sql_views", f"WITH {SHOP_EDGES} SELECT src AS fqn, count(DISTINCT dst) AS callees FROM g_edges WHERE kind = 'CALLS' GROUP BY 1")
def _(spark, d):
    tools.register_views(shop_graph(spark, d))
    return spark.sql("SELECT src AS fqn, count(DISTINCT dst) AS callees FROM graph_edges WHERE kind = 'CALLS' GROUP BY src")
