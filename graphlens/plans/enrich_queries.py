"""Enrichment questions over the shop graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.graph import Graph, edge_rows, node_rows
from graphlens.operators import enrich
from graphlens.plans.derived import APP, SHOP, key, shop_edges, shop_graph
from graphlens.plans.registry import query, table

OWNER = """owner AS (SELECT e.dst AS method, e.src AS owner FROM g_edges e JOIN g_nodes s ON s.fqn = e.src AND s.kind = 'CLASS'
  JOIN g_nodes t ON t.fqn = e.dst AND t.kind = 'FUNCTION' WHERE e.kind = 'CONTAINS')"""
MODULE_OF = """module_of AS (SELECT e.dst AS class_fqn, e.src AS module_fqn FROM g_edges e JOIN g_nodes s ON s.fqn = e.src
  AND s.kind = 'MODULE' JOIN g_nodes t ON t.fqn = e.dst AND t.kind = 'CLASS' WHERE e.kind = 'CONTAINS')"""
CLASS_CALLS = """class_calls AS (SELECT a.owner AS src, b.owner AS dst, count(*) AS weight FROM g_edges e
  JOIN owner a ON a.method = e.src JOIN owner b ON b.method = e.dst WHERE e.kind = 'CALLS' GROUP BY 1, 2)"""


@query("jn1_method_owner_map", f"WITH {SHOP}, {OWNER} SELECT method, owner FROM owner")
def _(spark, d):
    return enrich.method_owners(shop_graph(spark, d)).select("method", "owner")


@query("jn2_class_module_map", f"WITH {SHOP}, {MODULE_OF} SELECT class_fqn, module_fqn FROM module_of")
def _(spark, d):
    return enrich.class_modules(shop_graph(spark, d)).select("class_fqn", "module_fqn")


@query(
    "agg1_class_fan_metrics",
    f"""WITH {SHOP}, {OWNER},
    fi AS (SELECT o.owner AS c, count(*) AS n FROM g_edges e JOIN owner o ON o.method = e.dst WHERE e.kind = 'CALLS' GROUP BY 1
           UNION ALL SELECT dst, count(*) FROM g_edges WHERE kind = 'INJECTS' GROUP BY 1),
    fo AS (SELECT o.owner AS c, count(*) AS n FROM g_edges e JOIN owner o ON o.method = e.src WHERE e.kind = 'CALLS' GROUP BY 1)
    SELECT n.fqn AS class_fqn, CAST(coalesce((SELECT sum(n) FROM fi WHERE c = n.fqn), 0) AS BIGINT) AS fan_in,
           CAST(coalesce((SELECT sum(n) FROM fo WHERE c = n.fqn), 0) AS BIGINT) AS fan_out
    FROM g_nodes n WHERE n.kind = 'CLASS'""",
)
def _(spark, d):
    return enrich.fan_metrics(shop_graph(spark, d)).drop("app_name")


@query(
    "agg2_class_depends_on",
    f"""WITH {SHOP}, {OWNER}, {CLASS_CALLS} SELECT src, dst, weight FROM class_calls c WHERE src <> dst
    AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.kind = 'DEPENDS_ON' AND e.src = c.src AND e.dst = c.dst)""",
)
def _(spark, d):
    return enrich.class_dependencies(shop_graph(spark, d)).select("src", "dst", "weight")


@query(
    "agg3_module_imports",
    f"""WITH {SHOP}, {OWNER}, {MODULE_OF}, {CLASS_CALLS},
    deps AS (SELECT src, dst, weight FROM class_calls c WHERE src <> dst
               AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.kind = 'DEPENDS_ON' AND e.src = c.src AND e.dst = c.dst)
             UNION ALL SELECT src, dst, 1 FROM g_edges WHERE kind = 'DEPENDS_ON')
    SELECT a.module_fqn AS src, b.module_fqn AS dst, CAST(sum(weight) AS BIGINT) AS weight
    FROM deps JOIN module_of a ON a.class_fqn = src JOIN module_of b ON b.class_fqn = dst
    WHERE a.module_fqn <> b.module_fqn
      AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.kind = 'IMPORTS' AND e.src = a.module_fqn AND e.dst = b.module_fqn)
    GROUP BY 1, 2""",
)
def _(spark, d):
    g = shop_graph(spark, d)
    g = g.plus(edges=enrich.class_dependencies(g))
    return enrich.module_imports(g).select("src", "dst", "weight")


@query(
    "agg4_layer_nodes",
    f"""WITH {SHOP} SELECT 'layer:shop:' || layer AS fqn, layer AS name, count(*) AS node_count FROM g_nodes
    WHERE kind = 'CLASS' AND layer IS NOT NULL GROUP BY layer""",
)
def _(spark, d):
    return enrich.layer_nodes(shop_graph(spark, d)).select("fqn", "name", "node_count")


@query(
    "agg4_layer_contains",
    f"WITH {SHOP} SELECT 'layer:shop:' || layer AS src, fqn AS dst FROM g_nodes WHERE kind = 'CLASS' AND layer IS NOT NULL",
)
def _(spark, d):
    return enrich.layer_contains(shop_graph(spark, d)).select("src", "dst")


@query(
    "agg5_technology_components",
    f"""WITH {SHOP}, m AS (
      SELECT loc, CASE framework WHEN 'efcore' THEN 'entity-framework' ELSE framework END AS fw, layer,
             coalesce(language, 'unknown') AS language FROM g_nodes WHERE kind = 'CLASS'),
    t AS (SELECT loc, CASE WHEN fw IS NULL THEN layer ELSE coalesce(layer, CASE fw WHEN 'spring-boot' THEN 'Business Logic'
             WHEN 'django' THEN 'Presentation' ELSE 'Data Access' END) END AS layer, coalesce(fw, 'lang:' || language) AS tech FROM m)
    SELECT 'tech:shop:' || layer || ':' || tech AS fqn,
      CASE tech WHEN 'spring-boot' THEN 'Spring Boot' WHEN 'django' THEN 'Django' WHEN 'entity-framework' THEN 'Entity Framework'
        WHEN 'lang:java' THEN 'Java Classes' WHEN 'lang:python' THEN 'Python Classes' ELSE 'C# Classes' END AS name,
      CASE tech WHEN 'spring-boot' THEN 'di_container' WHEN 'django' THEN 'web_framework' WHEN 'entity-framework' THEN 'orm'
        ELSE 'language_classes' END AS category,
      count(*) AS class_count, CAST(sum(loc) AS BIGINT) AS loc_total, CAST(0 AS BIGINT) AS table_count
    FROM t WHERE layer IS NOT NULL GROUP BY layer, tech
    UNION ALL SELECT 'tech:shop:Data Access:db:database', 'Database', 'database', 0, 0, count(*) FROM g_nodes WHERE kind = 'TABLE'""",
)
def _(spark, d):
    return enrich.technology_nodes(shop_graph(spark, d)).select(
        "fqn", "name", "category", "class_count", "loc_total", "table_count"
    )


@query(
    "agg6_database_engine",
    """SELECT 's:' || s AS app_name, e AS engine, CASE WHEN e LIKE '%postgres%' THEN 'PostgreSQL' WHEN e LIKE '%mysql%' THEN 'MySQL'
         WHEN e LIKE '%sqlite%' THEN 'SQLite' WHEN e = 'database' THEN 'Database' ELSE 'Oracle' END AS display_name
    FROM (SELECT l_suppkey AS s, coalesce(min_by(
        CASE l_partkey % 5 WHEN 0 THEN 'postgresql' WHEN 1 THEN 'django.db.mysql' WHEN 2 THEN 'sqlite3' WHEN 3 THEN 'oracle' END,
        l_partkey) FILTER (WHERE l_partkey % 5 < 4), 'database') AS e FROM lineitem GROUP BY l_suppkey)""",
)
def _(spark, d):
    pairs = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    engines = F.expr(
        "CASE l_partkey % 5 WHEN 0 THEN 'postgresql' WHEN 1 THEN 'django.db.mysql' WHEN 2 THEN 'sqlite3' WHEN 3 THEN 'oracle' END"
    )
    nodes = node_rows(
        pairs.select(
            key("s", "l_suppkey").alias("app_name"), key("p", "l_partkey").alias("fqn"), F.lit("TABLE").alias("kind"),
            F.create_map(F.lit("engine"), engines).alias("props"), F.col("l_partkey").alias("seq"),
        )
    )
    return enrich.database_engine(Graph(nodes, edge_rows(shop_edges(spark, d).limit(0))))


def _dispatch_graph(spark, d):
    """Suppliers as interfaces, customers as classes; each order line ties a method pair."""
    lines = (
        table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select("l_suppkey", "o_custkey", "l_linenumber", "l_returnflag").distinct()
    )
    app = F.lit(APP).alias("app_name")
    up, impl = F.concat(key("is", "l_suppkey"), F.lit(".m")), F.concat(key("cc", "o_custkey"), F.lit(".m"))
    nodes = [
        (table(spark, d, "supplier"), key("is", "s_suppkey"), "INTERFACE", ""),
        (table(spark, d, "supplier"), key("is", "s_suppkey"), "FUNCTION", ".m"),
        (table(spark, d, "customer"), key("cc", "c_custkey"), "CLASS", ""),
        (table(spark, d, "customer"), key("cc", "c_custkey"), "FUNCTION", ".m"),
    ]
    n = None
    e = None
    for df, fqn, kind, tail in nodes:
        rows = node_rows(df.select(app, F.concat(fqn, F.lit(tail)).alias("fqn"), F.lit(kind).alias("kind")))
        n = rows if n is None else n.unionByName(rows)
        if tail:
            c = edge_rows(df.select(app, fqn.alias("src"), F.concat(fqn, F.lit(tail)).alias("dst"), F.lit("CONTAINS").alias("kind")))
            e = c if e is None else e.unionByName(c)
    forward = lines.filter("l_linenumber <= 3").select(app, impl.alias("src"), up.alias("dst"), F.lit("IMPLEMENTS").alias("kind"))
    backward = lines.filter("l_linenumber > 3").select(app, up.alias("src"), impl.alias("dst"), F.lit("IMPLEMENTS").alias("kind"))
    called = lines.filter("l_returnflag = 'R'").select(app, up.alias("src"), impl.alias("dst"), F.lit("CALLS").alias("kind"))
    for x in (forward, backward, called):
        e = e.unionByName(edge_rows(x))
    return Graph(n, e)


@query(
    "jn18_virtual_dispatch",
    """WITH l AS (SELECT DISTINCT l_suppkey, o_custkey, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT DISTINCT 'is:' || l_suppkey || '.m' AS src, 'cc:' || o_custkey || '.m' AS dst FROM l a
    WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.l_suppkey = a.l_suppkey AND b.o_custkey = a.o_custkey AND b.l_returnflag = 'R')""",
)
def _(spark, d):
    return enrich.virtual_dispatch(_dispatch_graph(spark, d)).select("src", "dst")


@query(
    "jn36_prune_orphan_modules",
    f"""WITH {SHOP}, n AS (SELECT fqn, kind FROM g_nodes UNION ALL SELECT 'm:' || p_partkey, 'MODULE' FROM part),
    e AS (SELECT src, dst, kind FROM g_edges UNION ALL SELECT 'm:' || l_partkey, 's:' || l_suppkey,
       CASE WHEN l_quantity > 49 THEN 'CONTAINS' ELSE 'IMPORTS' END FROM lineitem),
    o AS (SELECT fqn FROM n WHERE kind = 'MODULE' AND fqn NOT IN (SELECT src FROM e WHERE kind = 'CONTAINS'))
    SELECT kind, count(*) AS rows FROM e WHERE src NOT IN (SELECT fqn FROM o) AND dst NOT IN (SELECT fqn FROM o) GROUP BY kind
    UNION ALL SELECT 'node ' || kind, count(*) FROM n WHERE fqn NOT IN (SELECT fqn FROM o) GROUP BY kind""",
)
def _(spark, d):
    app = F.lit(APP).alias("app_name")
    modules = table(spark, d, "part").select(app, key("m", "p_partkey").alias("fqn"), F.lit("MODULE").alias("kind"))
    links = table(spark, d, "lineitem").select(
        app, key("m", "l_partkey").alias("src"), key("s", "l_suppkey").alias("dst"),
        F.when(F.col("l_quantity") > 49, "CONTAINS").otherwise("IMPORTS").alias("kind"),
    )
    g = enrich.prune_orphan_modules(shop_graph(spark, d).plus(nodes=modules, edges=links))
    edges = g.edges.groupBy("kind").agg(F.count("*").alias("rows"))
    nodes = g.nodes.groupBy("kind").agg(F.count("*").alias("rows"))
    return edges.unionByName(nodes.withColumn("kind", F.concat(F.lit("node "), "kind")))


@query(
    "flt12_layers_and_frameworks",
    """SELECT 'c:' || c_custkey AS fqn,
      CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'spring-boot' WHEN 'BUILDING' THEN 'hibernate' END AS framework,
      coalesce(CASE WHEN c_custkey % 7 = 0 THEN 'Own' END, a.layer,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Business Logic' WHEN 'BUILDING' THEN 'Data Access' END) AS layer
    FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS layer FROM orders WHERE o_orderstatus = 'P'
      GROUP BY 1) a ON o_custkey = c_custkey""",
)
def _(spark, d):
    nodes = node_rows(
        table(spark, d, "customer").select(
            F.lit(APP).alias("app_name"), key("c", "c_custkey").alias("fqn"), F.lit("CLASS").alias("kind"),
            F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.array(F.lit("Nullable"), F.lit("Service")))
            .when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("Entity"), F.lit("Service"))).alias("annotations"),
            F.when(F.col("c_custkey") % 7 == 0, F.lit("Own")).alias("layer"),
        )
    )
    assigned = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(
        F.lit(APP).alias("app_name"), key("c", "o_custkey").alias("fqn"), F.col("o_orderpriority").alias("layer"),
        F.col("o_orderkey").alias("seq"),
    )
    return enrich.apply_layers(Graph(nodes, shop_edges(spark, d)), assigned).select("fqn", "framework", "layer")
