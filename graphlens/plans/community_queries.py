"""Communities and ranks on the nation dependencies and the shop graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.graph import Graph, edge_rows, node_rows
from graphlens.operators import change, community, views
from graphlens.plans.change_queries import DIFF, pull_requests
from graphlens.plans.derived import SHOP, nation_dependencies, shop_graph, shop_nodes
from graphlens.plans.registry import query, table

_STEPS = ",\n".join(
    f"""r{i + 1} AS MATERIALIZED (SELECT n.fqn, 0.15 / (SELECT count(*) FROM n) + 0.85 * coalesce((SELECT sum(rank) FROM r{i} WHERE fqn NOT IN (SELECT src FROM deg)), 0)
      / (SELECT count(*) FROM n) + 0.85 * coalesce(f.inflow, 0) AS rank FROM n
    LEFT JOIN (SELECT e.dst, sum(r.rank / d.degree) AS inflow FROM e JOIN r{i} r ON r.fqn = e.src JOIN deg d ON d.src = e.src GROUP BY 1) f ON f.dst = n.fqn)"""
    for i in range(10)
)
RANK = f"""n AS MATERIALIZED (SELECT fqn FROM g_nodes), e AS MATERIALIZED (SELECT DISTINCT src, dst FROM g_edges WHERE kind IN ('CALLS', 'READS', 'WRITES', 'CONTAINS')),
  deg AS MATERIALIZED (SELECT src, count(*) AS degree FROM e GROUP BY 1),
  r0 AS MATERIALIZED (SELECT fqn, CAST(1 AS DOUBLE) / (SELECT count(*) FROM n) AS rank FROM n),\n{_STEPS}"""


@query("g11_pagerank", f"WITH {SHOP}, {RANK} SELECT fqn, round(rank, 9) AS pagerank FROM r10")
def _(spark, d):
    ranks = community.pagerank(shop_graph(spark, d), ["CALLS", "READS", "WRITES", "CONTAINS"])
    return ranks.withColumn("pagerank", F.round("pagerank", 9))


@query("g10_louvain_communities")
def _(spark, d):
    return community.louvain(Graph(shop_nodes(spark, d), nation_dependencies(spark, d)))


@query("g10_community_cover", "SELECT 'n:' || n_nationkey AS fqn, 1 AS memberships, TRUE AS known FROM nation")
def _(spark, d):
    """Every class is in one community, and communities are named by a class."""
    g = Graph(shop_nodes(spark, d), nation_dependencies(spark, d))
    members = community.louvain(g)
    names = g.of_kind("CLASS").select(F.col("fqn").alias("community"), F.lit(True).alias("known"))
    return members.join(names, "community", "left").groupBy("fqn").agg(F.count("*").alias("memberships"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known"))


@query("g10_community_summary")
def _(spark, d):
    g = Graph(shop_nodes(spark, d), nation_dependencies(spark, d))
    return community.community_summary(g, community.louvain(g))


# Lines hang on their order like stars without links between them: every star is one community.
STARS = """s AS MATERIALIZED (SELECT o_orderkey AS k, 'o:' || o_orderkey AS member FROM orders
    UNION SELECT l_orderkey, 'l:' || l_orderkey || ':' || l_linenumber FROM lineitem),
  home AS MATERIALIZED (SELECT k, min(member) AS community_id, count(*) AS size FROM s GROUP BY k)"""


def order_graph(spark, d):
    """Orders and their lines as classes; a line depends on its order."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    line, order = "concat('l:', l_orderkey, ':', l_linenumber)", "concat('o:', l_orderkey)"
    nodes = orders.selectExpr("concat('o:', o_orderkey) AS fqn", "'CLASS' AS kind").unionByName(lines.selectExpr(f"{line} AS fqn", "'CLASS' AS kind"))
    return Graph(node_rows(nodes), edge_rows(lines.selectExpr(f"{line} AS src", f"{order} AS dst", "'DEPENDS_ON' AS kind")))


def _order_communities(spark, d):
    return community.louvain(order_graph(spark, d), 1e-12)


@query("agg12_computed_communities", f"WITH {STARS} SELECT community_id, size, member FROM s JOIN home USING (k)")
def _(spark, d):
    return views.communities(_order_communities(spark, d).select(F.col("community").alias("community_id"), F.col("fqn").alias("name")))


@query("agg13_computed_community_count", f"WITH {STARS} SELECT count(*) AS communities FROM home")
def _(spark, d):
    return _order_communities(spark, d).agg(F.count_distinct("community").alias("communities"))


# Rank passes along edges as a series of shrinking terms; their sum, scaled to 1, is the limit.
LIMIT_RANK = """n AS MATERIALIZED (SELECT fqn FROM g_nodes), e AS MATERIALIZED (SELECT DISTINCT src, dst FROM g_edges WHERE kind IN ('CALLS', 'READS', 'WRITES', 'CONTAINS')),
  deg AS MATERIALIZED (SELECT src, count(*) AS degree FROM e GROUP BY 1),
  term(i, fqn, amount) AS (SELECT 0, fqn, CAST(0.15 AS DOUBLE) / (SELECT count(*) FROM n) FROM n
    UNION ALL SELECT t.i + 1, e.dst, sum(0.85 * t.amount / deg.degree) FROM term t JOIN e ON e.src = t.fqn JOIN deg ON deg.src = t.fqn WHERE t.i < 150 GROUP BY 1, 2),
  y AS MATERIALIZED (SELECT fqn, sum(amount) AS amount FROM term GROUP BY 1),
  ranks AS MATERIALIZED (SELECT fqn, amount / (SELECT sum(amount) FROM y) AS rank FROM y)"""
RANK_KINDS = ["CALLS", "READS", "WRITES", "CONTAINS"]


@query("g11_pagerank_limit", f"WITH RECURSIVE {SHOP}, {LIMIT_RANK} SELECT fqn, round(rank, 8) AS pagerank FROM ranks")
def _(spark, d):
    return community.pagerank_within(shop_graph(spark, d), RANK_KINDS, 1e-8).withColumn("pagerank", F.round("pagerank", 8))


@query(
    "agg16_changed_node_hubs",
    f"""WITH RECURSIVE {SHOP}, {DIFF}, {LIMIT_RANK}, f AS (SELECT dst, count(DISTINCT src) AS n FROM g_edges WHERE kind = 'CALLS' GROUP BY 1)
    SELECT DISTINCT pr_id, c.fqn, coalesce(n, 0) AS fan_in, coalesce(rank > 0.05, FALSE) AS is_hub FROM changed c LEFT JOIN f ON dst = c.fqn LEFT JOIN ranks r ON r.fqn = c.fqn""",
)
def _(spark, d):
    g = shop_graph(spark, d)
    ranks = community.pagerank_within(g, RANK_KINDS)
    return change.changed_enriched(g, change.map_diffs(g, pull_requests(spark, d))[0], ranks)
