"""Read questions over the shop graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.graph import Graph, edge_rows, node_rows
from graphlens.operators import traverse, views
from graphlens.plans.derived import APP, SHOP, SHOP_EDGES, SHOP_NODES, shop_edges, shop_graph, shop_nodes
from graphlens.plans.enrich_queries import MODULE_OF, OWNER
from graphlens.plans.registry import query, table
from graphlens.plans.traverse_queries import LABEL, TRACE_CTE


@query("flt1_node_page", f"WITH {SHOP_NODES} SELECT fqn, name, kind, language, loc FROM g_nodes WHERE kind = 'FUNCTION' ORDER BY fqn LIMIT 50 OFFSET 50")
def _(spark, d):
    rows = views.list_nodes(shop_graph(spark, d), kind="FUNCTION").select("fqn", "name", "kind", "language", "loc")
    return views.page(rows, ["fqn"], 50, 50)


@query("flt1_node_total", f"WITH {SHOP_NODES} SELECT count(*) AS total FROM g_nodes WHERE kind = 'FUNCTION' AND language = 'sql'")
def _(spark, d):
    return views.list_nodes(shop_graph(spark, d), "FUNCTION", "sql").agg(F.count("*").alias("total"))


@query("flt2_edge_page", f"WITH {SHOP_EDGES} SELECT DISTINCT src, dst, kind FROM g_edges WHERE kind = 'CALLS' ORDER BY src, dst, kind LIMIT 100 OFFSET 20")
def _(spark, d):
    rows = views.list_edges(shop_graph(spark, d), "CALLS").select("src", "dst", "kind").distinct()
    return views.page(rows, ["src", "dst", "kind"], 20, 100)


@query(
    "flt3_search",
    f"""WITH {SHOP_NODES} SELECT fqn, name, {LABEL} AS type, CAST(1.0 AS DOUBLE) AS score FROM g_nodes n
    WHERE contains(lower(name), 'ring') OR contains(lower(fqn), 'ring') ORDER BY fqn LIMIT 50""",
)
def _(spark, d):
    return views.search(shop_graph(spark, d), "RING").orderBy("fqn").limit(50)


@query(
    "flt4_search_by_type",
    f"""WITH {SHOP_NODES} SELECT fqn, name, 'Function' AS type FROM g_nodes WHERE kind = 'FUNCTION'
    AND (contains(lower(name), '#00000001') OR contains(lower(fqn), '#00000001'))""",
)
def _(spark, d):
    return views.search(shop_graph(spark, d), "#00000001", "Function").drop("score")


@query(
    "flt5_property_split",
    f"""WITH {SHOP_NODES} SELECT fqn, name, kind, language, path, line, loc,
      concat_ws(',', CASE WHEN app IS NOT NULL THEN 'app_name=' || app END, CASE WHEN complexity IS NOT NULL THEN 'complexity=' || complexity END,
        CASE WHEN end_line IS NOT NULL THEN 'end_line=' || end_line END, CASE WHEN framework IS NOT NULL THEN 'framework=' || framework END,
        CASE WHEN is_constructor THEN 'is_constructor=true' END, CASE WHEN layer IS NOT NULL THEN 'layer=' || layer END) AS properties
    FROM (SELECT *, 'shop' AS app FROM g_nodes)""",
)
def _(spark, d):
    split = views.core_and_extra(shop_graph(spark, d))
    entries = F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return split.withColumn("properties", F.array_join(entries, ","))


@query("flt6_classes_of_module", f"WITH {SHOP}, {MODULE_OF} SELECT module_fqn AS parent, fqn, name FROM module_of JOIN g_nodes ON fqn = class_fqn")
def _(spark, d):
    g = shop_graph(spark, d)
    return views.children(g, g.of_kind("MODULE"), ["CLASS"]).select("parent", "fqn", "name")


@query("flt6_methods_of_class", f"WITH {SHOP}, {OWNER} SELECT owner AS parent, fqn, name FROM owner JOIN g_nodes ON fqn = method")
def _(spark, d):
    g = shop_graph(spark, d)
    return views.children(g, g.of_kind("CLASS"), ["FUNCTION"]).select("parent", "fqn", "name")


@query("flt7_transactions", "SELECT 'o:' || o_orderkey AS fqn, 'order ' || o_orderkey AS name FROM orders")
def _(spark, d):
    return shop_graph(spark, d).of_kind("TRANSACTION").select("fqn", "name").orderBy("name")


@query(
    "flt9_symbol_roles",
    """SELECT count(*) FILTER (l_quantity::BIGINT & 1 <> 0) AS definitions, count(*) FILTER (l_quantity::BIGINT & 1 = 0) AS refs,
      count(*) FILTER (l_quantity::BIGINT & 4 <> 0) AS writes, count(*) FILTER (l_quantity::BIGINT & 8 <> 0) AS reads FROM lineitem""",
)
def _(spark, d):
    roles = F.col("l_quantity").cast("int")
    return table(spark, d, "lineitem").agg(
        F.count_if(views.has_role(roles, 1)).alias("definitions"), F.count_if(~views.has_role(roles, 1)).alias("refs"),
        F.count_if(views.has_role(roles, 4)).alias("writes"), F.count_if(views.has_role(roles, 8)).alias("reads"),
    )


@query(
    "flt10_layer_rules",
    """SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'Presentation' WHEN contains(p_name, 'red') THEN 'Business Logic'
      WHEN contains(p_name, 'b') THEN 'Data Access' END AS layer FROM part""",
)
def _(spark, d):
    rules = [("ring", "Presentation"), ("red", "Business Logic"), ("b", "Data Access")]
    return table(spark, d, "part").select("p_partkey", views.classify_by_rules(F.col("p_name"), rules).alias("layer"))


@query(
    "flt11_stereotype_layer",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Data Access' WHEN 'AUTOMOBILE' THEN 'Business Logic'
      WHEN 'MACHINERY' THEN 'Presentation' END AS layer FROM customer""",
)
def _(spark, d):
    annotations = F.expr(
        "CASE c_mktsegment WHEN 'BUILDING' THEN array('Lazy', 'Repository', 'Service') WHEN 'AUTOMOBILE' THEN array('Service') "
        "WHEN 'MACHINERY' THEN array('RestController', 'Configuration') ELSE array('Lazy') END"
    )
    return table(spark, d, "customer").select("c_custkey", views.stereotype_layer(annotations).alias("layer"))


@query(
    "jn3_incident_edges",
    f"""WITH {SHOP_EDGES} SELECT fqn, direction, kind, count(*) AS neighbours FROM (
      SELECT DISTINCT src AS fqn, 'out' AS direction, kind, dst AS n FROM g_edges UNION ALL SELECT DISTINCT dst, 'in', kind, src FROM g_edges)
    GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return views.incident_edges(shop_graph(spark, d)).groupBy("fqn", "direction", "kind").agg(F.count("*").alias("neighbours"))


@query(
    "jn4_node_details",
    f"""WITH {SHOP} SELECT fqn, name, 'Function' AS type, loc, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM g_nodes
    LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM g_edges WHERE kind = 'CALLS' GROUP BY 1) i ON i.dst = fqn
    LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM g_edges WHERE kind = 'CALLS' GROUP BY 1) o ON o.src = fqn WHERE kind = 'FUNCTION'""",
)
def _(spark, d):
    return views.node_details(shop_graph(spark, d))


@query(
    "jn4_call_partners",
    f"""WITH {SHOP}, p AS (SELECT DISTINCT src, dst FROM g_edges WHERE kind = 'CALLS')
    SELECT dst AS fqn, 'caller' AS role, src AS partner, name AS partner_name FROM p JOIN g_nodes n ON n.fqn = src
    UNION ALL SELECT src, 'callee', dst, name FROM p JOIN g_nodes n ON n.fqn = dst""",
)
def _(spark, d):
    return views.call_partners(shop_graph(spark, d)).select("fqn", "role", "partner", "partner_name")


@query(
    "agg11_distinct_fans",
    f"""WITH {SHOP_EDGES}, p AS (SELECT DISTINCT src, dst FROM g_edges WHERE kind = 'CALLS')
    SELECT fqn, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT dst AS fqn, 1 AS i, 0 AS o FROM p
      UNION ALL SELECT src, 0, 1 FROM p) GROUP BY fqn""",
)
def _(spark, d):
    return views.distinct_fans(shop_graph(spark, d))


DEAD = """SELECT fqn, name, path, line, loc FROM g_nodes n WHERE kind = 'FUNCTION' AND loc >= {loc} AND NOT coalesce(is_constructor, FALSE)
  AND NOT list_has_any(coalesce(annotations, []), ['PostConstruct', 'EventListener', 'Scheduled', 'Bean', 'Test'])
  AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.kind = 'CALLS' AND e.dst = n.fqn)"""


@query("jn37_dead_functions", f"WITH {SHOP} {DEAD.format(loc=500)}")
def _(spark, d):
    return views.dead_functions(shop_graph(spark, d), 500)


@query(
    "jn37_dead_classes",
    f"""WITH {SHOP} SELECT fqn, name, path, line, loc FROM g_nodes n WHERE kind = 'CLASS' AND loc >= 20
    AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.kind IN ('DEPENDS_ON', 'CALLS') AND e.dst = n.fqn)""",
)
def _(spark, d):
    return views.dead_classes(shop_graph(spark, d), 20)


@query("top3_largest_dead_code", f"WITH {SHOP} {DEAD.format(loc=0)} ORDER BY loc DESC, fqn LIMIT 100")
def _(spark, d):
    return views.top(views.dead_functions(shop_graph(spark, d)), "loc", 100)


@query("agg13_uncalled_functions", f"WITH {SHOP} SELECT count(*) AS dead_code_count FROM g_nodes n WHERE kind = 'FUNCTION' AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.kind = 'CALLS' AND e.dst = n.fqn)")
def _(spark, d):
    return views.uncalled_function_count(shop_graph(spark, d))


@query(
    "agg9_overview",
    f"""WITH {SHOP_NODES} SELECT count(*) FILTER (kind = 'MODULE') AS modules, count(*) FILTER (kind = 'CLASS') AS classes,
      count(*) FILTER (kind = 'FUNCTION') AS functions, CAST(sum(coalesce(loc, 0)) AS BIGINT) AS total_loc FROM g_nodes""",
)
def _(spark, d):
    return views.overview(shop_graph(spark, d))


@query("agg10_counts_by_label", f"WITH {SHOP_NODES} SELECT {LABEL} AS type, count(*) AS nodes, CAST(coalesce(sum(loc), 0) AS BIGINT) AS total_loc FROM g_nodes n GROUP BY 1")
def _(spark, d):
    return views.counts_by_label(shop_graph(spark, d))


@query(
    "agg12_communities",
    """SELECT c_nationkey AS community_id, count(*) OVER (PARTITION BY c_nationkey) AS size, c_name AS member FROM customer""",
)
def _(spark, d):
    members = table(spark, d, "customer").selectExpr("c_nationkey AS community_id", "c_name AS name")
    return views.communities(members)


@query(
    "agg13_community_count",
    "SELECT count(DISTINCT c_nationkey) AS communities FROM customer",
)
def _(spark, d):
    return table(spark, d, "customer").agg(F.count_distinct("c_nationkey").alias("communities"))


CLASS_EDGES = f"""{OWNER}, {MODULE_OF}, class_edges AS (SELECT a.owner AS source, b.owner AS target, 'CALLS' AS kind, count(*) AS weight
    FROM g_edges e JOIN owner a ON a.method = e.src JOIN owner b ON b.method = e.dst WHERE e.kind = 'CALLS' AND a.owner <> b.owner GROUP BY 1, 2
  UNION ALL SELECT src, dst, 'DEPENDS_ON', count(*) FROM g_edges WHERE kind = 'DEPENDS_ON' AND src <> dst GROUP BY 1, 2)"""


@query("agg7_class_edges", f"WITH {SHOP}, {CLASS_EDGES} SELECT source, target, kind, weight FROM class_edges")
def _(spark, d):
    return views.aggregated_class_edges(shop_graph(spark, d))


@query("set1_union_all_regroup", f"WITH {SHOP}, {CLASS_EDGES} SELECT kind, count(*) AS pairs, CAST(sum(weight) AS BIGINT) AS weight FROM class_edges GROUP BY kind")
def _(spark, d):
    return views.aggregated_class_edges(shop_graph(spark, d)).groupBy("kind").agg(F.count("*").alias("pairs"), F.sum("weight").alias("weight"))


@query("top4_heaviest_class_edges", f"WITH {SHOP}, {CLASS_EDGES} SELECT source, target, kind, weight FROM class_edges ORDER BY weight DESC, source, target, kind LIMIT 100")
def _(spark, d):
    return views.aggregated_class_edges(shop_graph(spark, d)).orderBy(F.desc("weight"), "source", "target", "kind").limit(100)


@query(
    "agg8_module_edges",
    f"""WITH {SHOP}, {CLASS_EDGES} SELECT a.module_fqn AS source, b.module_fqn AS target, kind, CAST(sum(weight) AS BIGINT) AS weight FROM class_edges
    JOIN module_of a ON a.class_fqn = source JOIN module_of b ON b.class_fqn = target WHERE a.module_fqn <> b.module_fqn GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return views.aggregated_module_edges(shop_graph(spark, d))


# --- architecture over customers as classes -------------------------------------------------


def _component_graph(spark, d):
    """Customer segments as components of layers; each call ties a customer to a supplier component."""
    customer, supplier = table(spark, d, "customer"), table(spark, d, "supplier")
    app = f"'{APP}' AS app_name"
    segment = customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.floor(F.abs("c_acctbal"))).alias("loc")).selectExpr(
        app, "concat('tech:', c_mktsegment) AS fqn", "c_mktsegment AS name", "'COMPONENT' AS kind",
        "map('class_count', cast(n AS string), 'loc_total', cast(loc AS string)) AS props",
    )
    nation = supplier.groupBy("s_nationkey").agg(F.count("*").alias("n")).selectExpr(
        app, "concat('tech:n', s_nationkey) AS fqn", "concat('n', s_nationkey) AS name", "'COMPONENT' AS kind",
        "map('class_count', cast(n AS string), 'loc_total', '0') AS props",
    )
    region = table(spark, d, "region").selectExpr(app, "concat('layer:', r_regionkey) AS fqn", "r_name AS name", "'LAYER' AS kind")
    nodes = shop_nodes(spark, d).unionByName(node_rows(segment)).unionByName(node_rows(nation)).unionByName(node_rows(region))
    contains = (
        customer.selectExpr(app, "concat('tech:', c_mktsegment) AS src", "concat('c:', c_custkey) AS dst", "'CONTAINS' AS kind")
        .union(supplier.selectExpr(app, "concat('tech:n', s_nationkey) AS src", "concat('s:', s_suppkey) AS dst", "'CONTAINS' AS kind"))
        .union(table(spark, d, "nation").selectExpr(app, "concat('layer:', n_regionkey) AS src", "concat('tech:n', n_nationkey) AS dst", "'CONTAINS' AS kind"))
        .union(customer.selectExpr(app, "'layer:0' AS src", "concat('tech:', c_mktsegment) AS dst", "'CONTAINS' AS kind").distinct())
    )
    return Graph(nodes, shop_edges(spark, d).unionByName(edge_rows(contains)))


@query(
    "agg17_architecture_layers",
    """WITH c AS (SELECT 0 AS r, c_mktsegment AS component, count(*) AS class_count, CAST(sum(floor(abs(c_acctbal))) AS BIGINT) AS loc_total FROM customer GROUP BY 2
      UNION ALL SELECT n_regionkey, 'n' || n_nationkey, count(*), 0 FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT r_name AS layer, component, class_count, loc_total,
      CAST(coalesce(sum(class_count) OVER (PARTITION BY r_regionkey), 0) AS BIGINT) AS layer_classes,
      CAST(coalesce(sum(loc_total) OVER (PARTITION BY r_regionkey), 0) AS BIGINT) AS layer_loc
    FROM region LEFT JOIN c ON r = r_regionkey""",
)
def _(spark, d):
    return views.architecture_layers(_component_graph(spark, d))


@query(
    "agg18_component_links",
    """SELECT 'tech:' || c_mktsegment AS source, 'tech:n' || s_nationkey AS target, count(*) AS weight, 'CALLS' AS kinds
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
)
def _(spark, d):
    return views.component_links(_component_graph(spark, d))


@query(
    "agg19_class_graph_extract",
    f"""WITH {SHOP} SELECT 'node' AS part, fqn AS source, name AS target, loc AS weight FROM g_nodes WHERE kind = 'CLASS'
    UNION ALL SELECT 'edge', src, dst, NULL FROM g_edges WHERE kind = 'DEPENDS_ON'""",
)
def _(spark, d):
    nodes, edges = views.architecture_extract(shop_graph(spark, d), "class")
    return nodes.selectExpr("'node' AS part", "fqn AS source", "name AS target", "loc AS weight").unionByName(
        edges.selectExpr("'edge' AS part", "source", "target", "cast(weight AS int) AS weight")
    )


@query("jn41_module_list", f"WITH {SHOP}, {MODULE_OF} SELECT fqn, name, count(class_fqn) AS class_count FROM g_nodes LEFT JOIN module_of ON module_fqn = fqn WHERE kind = 'MODULE' GROUP BY 1, 2")
def _(spark, d):
    return views.module_list(shop_graph(spark, d))


@query(
    "jn41_application_list",
    """SELECT 'a:' || c_custkey AS app_name, coalesce(n, 0) AS module_count,
      CASE WHEN c_acctbal > 0 THEN 'repo' || c_nationkey ELSE 'unknown' END AS repository,
      CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE 'unknown' END AS branch
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
)
def _(spark, d):
    apps = table(spark, d, "customer").selectExpr("concat('a:', c_custkey) AS app_name", "concat('a:', c_custkey) AS fqn", "c_name AS name", "'APPLICATION' AS kind")
    modules = table(spark, d, "orders").selectExpr("concat('a:', o_custkey) AS app_name", "concat('m:', o_orderkey) AS fqn", "'MODULE' AS kind")
    projects = table(spark, d, "customer").filter("c_acctbal > 0").selectExpr(
        "concat('a:', c_custkey) AS id", "concat('repo', c_nationkey) AS repository", "CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS branch"
    )
    graph = Graph(node_rows(apps).unionByName(node_rows(modules)), shop_edges(spark, d))
    return views.application_list(graph, projects)


@query(
    "jn39_transaction_edges",
    """WITH inc AS MATERIALIZED (SELECT DISTINCT l_orderkey AS o, 's:' || l_suppkey AS m FROM lineitem UNION SELECT DISTINCT o_orderkey, 'c:' || o_custkey FROM orders),
    calls AS MATERIALIZED (SELECT DISTINCT 'c:' || o_custkey AS src, 's:' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    pair AS MATERIALIZED (SELECT a.o, a.m AS src, b.m AS dst FROM inc a JOIN inc b ON b.o = a.o)
    SELECT 'o:' || o AS transaction, src, dst, 'CALLS' AS kind FROM pair JOIN calls USING (src, dst)""",
)
def _(spark, d):
    g = shop_graph(spark, d)
    starts = table(spark, d, "orders").selectExpr(f"'{APP}' AS app_name", "concat('o:', o_orderkey) AS src", "concat('c:', o_custkey) AS dst", "'INCLUDES' AS kind")
    return views.transaction_edges(g.plus(edges=starts), g.of_kind("TRANSACTION"))


@query("jn40_affected_transactions", "SELECT DISTINCT 's:' || l_suppkey AS fqn, 'order ' || l_orderkey AS transaction FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def _(spark, d):
    g = shop_graph(spark, d)
    return views.affected_transactions(g, g.of_kind("FUNCTION"))


#: The text of ``placed(key, part, item)``; digests of ranges of 256 sorted items where there are more.
RANGE_TEXTS = """numbered AS (SELECT *, (row_number() OVER (PARTITION BY key, part ORDER BY item) - 1) // 256 AS run FROM placed),
    ranges AS (SELECT key, part, run, string_agg(item, ',' ORDER BY item) AS text FROM numbered GROUP BY 1, 2, 3),
    texts AS (SELECT key, part, CASE WHEN count(*) = 1 THEN min(text) ELSE string_agg(sha256(text), ',' ORDER BY run) END AS text FROM ranges GROUP BY 1, 2)"""


@query(
    "agg27_neighbourhood_hash",
    f"""WITH {SHOP_EDGES}, p AS (SELECT DISTINCT src, dst FROM g_edges WHERE kind = 'CALLS'),
    x AS (SELECT dst AS fqn, src AS n, 1 AS i, 0 AS o FROM p UNION ALL SELECT src, dst, 0, 1 FROM p),
    placed AS (SELECT fqn AS key, 0 AS part, n AS item FROM x), {RANGE_TEXTS}, fans AS (SELECT fqn, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o FROM x GROUP BY fqn)
    SELECT fqn, sha256(i || ':' || o || ':' || text) AS graph_hash FROM fans JOIN texts ON key = fqn""",
)
def _(spark, d):
    return views.neighbourhood_hashes(shop_graph(spark, d))


def _supplier_trace(spark, d, part):
    g = shop_graph(spark, d)
    return part(g, g.of_kind("FUNCTION").filter("language = 'sql'").select("fqn"))


@query(
    "agg28_trace_hash",
    f"""WITH {SHOP}, {TRACE_CTE}, placed AS (SELECT seed AS key, direction AS part, node AS item FROM shown), {RANGE_TEXTS}
    SELECT key AS seed, sha256(key || ':' || coalesce(max(text) FILTER (part = 'upstream'), '') || ':' || coalesce(max(text) FILTER (part = 'downstream'), '')) AS trace_hash
    FROM texts GROUP BY key""",
)
def _(spark, d):
    return views.trace_hashes(_supplier_trace(spark, d, traverse.trace_nodes))


@query("agg29_tables_touched", "SELECT DISTINCT 's:' || l_suppkey AS seed, CAST(l_partkey AS VARCHAR) AS table_name, CASE WHEN l_linestatus = 'O' THEN 'READS' ELSE 'WRITES' END AS access_type FROM lineitem")
def _(spark, d):
    return views.tables_touched(_supplier_trace(spark, d, traverse.trace_access))


@query("top1_stable_page", f"WITH {SHOP_NODES} SELECT fqn FROM g_nodes ORDER BY fqn LIMIT 200 OFFSET 1000")
def _(spark, d):
    return views.page(shop_graph(spark, d).nodes.select("fqn"), ["fqn"], 1000, 200)


@query("top2_most_complex", f"WITH {SHOP_NODES} SELECT fqn, name, complexity AS value FROM g_nodes WHERE kind = 'CLASS' AND complexity IS NOT NULL ORDER BY value DESC, fqn LIMIT 10")
def _(spark, d):
    return views.top(shop_graph(spark, d).of_kind("CLASS").select("fqn", "name", F.col("complexity").alias("value")), "value", 10)


@query("top2_highest_fan_in", f"WITH {SHOP_EDGES} SELECT dst AS fqn, count(DISTINCT src) AS value FROM g_edges WHERE kind = 'CALLS' GROUP BY 1 ORDER BY value DESC, fqn LIMIT 10")
def _(spark, d):
    return views.top(views.distinct_fans(shop_graph(spark, d)).select("fqn", F.col("fan_in").alias("value")), "value", 10)


@query("top2_highest_fan_out", f"WITH {SHOP_EDGES} SELECT src AS fqn, count(DISTINCT dst) AS value FROM g_edges WHERE kind = 'CALLS' GROUP BY 1 ORDER BY value DESC, fqn LIMIT 10")
def _(spark, d):
    return views.top(views.distinct_fans(shop_graph(spark, d)).select("fqn", F.col("fan_out").alias("value")), "value", 10)


@query(
    "top5_capped_partners",
    f"""WITH {SHOP_EDGES} SELECT fqn, partner FROM (SELECT dst AS fqn, src AS partner, row_number() OVER (PARTITION BY dst ORDER BY src) AS r
      FROM (SELECT DISTINCT src, dst FROM g_edges WHERE kind = 'CALLS')) WHERE r <= 50""",
)
def _(spark, d):
    return views.capped_partners(shop_graph(spark, d))


@query(
    "set3_orphan_difference",
    f"WITH {SHOP} SELECT fqn FROM g_nodes WHERE kind = 'TABLE' EXCEPT SELECT dst FROM g_edges WHERE kind = 'WRITES'",
)
def _(spark, d):
    return views.without_incoming(shop_graph(spark, d), "TABLE", "WRITES")


@query("set4_annotation_intersection", f"WITH {SHOP_NODES} SELECT fqn FROM g_nodes WHERE list_has_any(annotations, ['Service', 'Component'])")
def _(spark, d):
    return views.annotated(shop_graph(spark, d), ["Service", "Component"])


@query("set5_distinct_edges", f"WITH {SHOP_EDGES} SELECT kind, count(*) AS pairs FROM (SELECT DISTINCT src, dst, kind FROM g_edges) GROUP BY kind")
def _(spark, d):
    return views.distinct_edge_counts(shop_graph(spark, d))


@query(
    "set6_graph_comparison",
    """WITH a AS (SELECT 'p:' || p_partkey AS key, p_size AS loc FROM part), l AS (SELECT DISTINCT l_suppkey, l_partkey, l_linestatus FROM lineitem),
    b AS (SELECT 'p:' || l_partkey AS key, CAST(max(l_quantity) AS INTEGER) AS loc FROM lineitem WHERE l_quantity < 30 GROUP BY 1),
    ae AS (SELECT DISTINCT 's:' || l_suppkey || ' READS p:' || l_partkey AS key FROM l WHERE l_linestatus = 'O'),
    be AS (SELECT DISTINCT 's:' || l_suppkey || ' READS p:' || l_partkey AS key FROM l WHERE l_linestatus <> 'O')
    SELECT 'node' AS item, coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM a FULL JOIN b ON a.key = b.key WHERE a.loc IS DISTINCT FROM b.loc
    UNION ALL SELECT 'edge', key, 'removed' FROM ae WHERE key NOT IN (SELECT key FROM be)
    UNION ALL SELECT 'edge', key, 'added' FROM be WHERE key NOT IN (SELECT key FROM ae)""",
)
def _(spark, d):
    line = table(spark, d, "lineitem")
    before = node_rows(table(spark, d, "part").selectExpr("concat('p:', p_partkey) AS fqn", "p_size AS loc"))
    after = node_rows(line.filter("l_quantity < 30").groupBy("l_partkey").agg(F.max("l_quantity").alias("q")).selectExpr("concat('p:', l_partkey) AS fqn", "q AS loc"))

    def edges(condition):
        return edge_rows(line.filter(condition).selectExpr("concat('s:', l_suppkey) AS src", "concat('p:', l_partkey) AS dst", "'READS' AS kind"))

    return views.compare_graphs(Graph(before, edges("l_linestatus = 'O'")), Graph(after, edges("l_linestatus <> 'O'")))


@query(
    "set6_changed_edges",
    """WITH w AS (SELECT 's:' || l_suppkey || ' READS p:' || l_partkey AS key, l_linestatus AS side, CAST(max(l_linenumber) AS INTEGER) AS weight FROM lineitem GROUP BY ALL),
    a AS (SELECT key, weight FROM w WHERE side = 'O'), b AS (SELECT key, weight FROM w WHERE side <> 'O')
    SELECT key, CASE WHEN a.weight IS NULL THEN 'added' WHEN b.weight IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM a FULL JOIN b USING (key) WHERE a.weight IS DISTINCT FROM b.weight""",
)
def _(spark, d):
    weights = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey", "l_linestatus").agg(F.max("l_linenumber").cast("int").alias("weight"))
    part = node_rows(table(spark, d, "part").selectExpr("concat('p:', p_partkey) AS fqn"))

    def build(condition):
        rows = weights.filter(condition).selectExpr("concat('s:', l_suppkey) AS src", "concat('p:', l_partkey) AS dst", "'READS' AS kind", "weight")
        return Graph(part, edge_rows(rows))

    return views.compare_graphs(build("l_linestatus = 'O'"), build("l_linestatus <> 'O'")).filter("item = 'edge'").drop("item")
