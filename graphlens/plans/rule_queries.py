"""Framework rules over code derived from the trade tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.graph import Graph, edge_rows, node_rows
from graphlens.operators import rules
from graphlens.operators.rules import endpoints, injection, messaging
from graphlens.plans.registry import query, table


def build(nodes, edges):
    """Graph from lists of text projections."""
    n, e = node_rows(nodes[0]), edge_rows(edges[0])
    for x in nodes[1:]:
        n = n.union(node_rows(x))
    for x in edges[1:]:
        e = e.union(edge_rows(x))
    return Graph(n, e)


def trades(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))


# --- beans -----------------------------------------------------------------------------------

BEAN = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'A' || c_nationkey ELSE 'U' || c_custkey END"


def bean_graph(spark, d):
    customer, supplier, nation = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "nation")
    asked = trades(spark, d).select("l_suppkey", "o_custkey").distinct().join(customer, F.expr("o_custkey = c_custkey"))
    nodes = [
        customer.selectExpr(
            "concat('com.B', c_custkey) AS fqn", f"{BEAN} AS name", "'CLASS' AS kind", "c_custkey AS seq",
            "CASE WHEN c_mktsegment = 'BUILDING' THEN array('Entity') WHEN c_acctbal > 9000 THEN array('Service', 'Primary') ELSE array('Service') END AS annotations",
        ),
        nation.selectExpr("concat('com.I', n_nationkey) AS fqn", "concat('I', n_nationkey) AS name", "'INTERFACE' AS kind"),
        supplier.selectExpr("concat('com.S', s_suppkey) AS fqn", "concat('S', s_suppkey) AS name", "'CLASS' AS kind", "array('Controller') AS annotations"),
        supplier.selectExpr(
            "concat('com.S', s_suppkey, '.new') AS fqn", "'new' AS name", "'FUNCTION' AS kind", "true AS is_constructor",
            "array(named_struct('name', 'x', 'type', concat('I', s_nationkey), 'annotations', array(''), 'qualifier', '')) AS params",
        ),
        asked.selectExpr(
            "concat('com.S', l_suppkey, '.f', c_custkey) AS fqn", "concat('f', c_custkey) AS name", "'FIELD' AS kind", "array('Autowired') AS annotations",
            f"{BEAN} AS type", "CASE WHEN c_acctbal < 0 THEN map('Qualifier', concat('a', c_nationkey)) END AS annotation_args",
        ),
    ]
    edges = [
        supplier.selectExpr("concat('com.S', s_suppkey) AS src", "concat('com.S', s_suppkey, '.new') AS dst", "'CONTAINS' AS kind"),
        asked.selectExpr("concat('com.S', l_suppkey) AS src", "concat('com.S', l_suppkey, '.f', c_custkey) AS dst", "'CONTAINS' AS kind"),
        customer.filter("c_mktsegment = 'HOUSEHOLD'").selectExpr("concat('com.B', c_custkey) AS src", "concat('com.I', c_nationkey) AS dst", "'IMPLEMENTS' AS kind"),
    ]
    return build(nodes, edges)


@query(
    "jn20_bean_injection",
    f"""WITH bean AS (SELECT {BEAN} AS wanted, c_custkey AS k, c_acctbal > 9000 AS prim FROM customer WHERE c_mktsegment <> 'BUILDING'
      UNION ALL SELECT 'I' || c_nationkey, c_custkey, c_acctbal > 9000 FROM customer WHERE c_mktsegment = 'HOUSEHOLD'),
    s AS (SELECT wanted, count(*) AS n, sum(prim::INT) AS p, min(k) FILTER (prim) AS pk, min(k) AS first_k FROM bean GROUP BY 1),
    site AS (SELECT DISTINCT l_suppkey AS sup, {BEAN} AS wanted, c_acctbal < 0 AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      UNION SELECT s_suppkey, 'I' || s_nationkey, FALSE FROM supplier),
    r AS (SELECT sup, site.wanted, CASE WHEN n = 1 THEN first_k WHEN p = 1 THEN pk WHEN q AND site.wanted LIKE 'A%' THEN first_k END AS k FROM site JOIN s ON s.wanted = site.wanted)
    SELECT DISTINCT 'com.S' || sup AS src, 'com.B' || k AS dst, 'HIGH' AS confidence FROM r WHERE k IS NOT NULL
    UNION SELECT DISTINCT 'com.S' || sup, 'com.B' || b.k, 'LOW' FROM r JOIN bean b ON b.wanted = r.wanted WHERE r.k IS NULL""",
)
def _(spark, d):
    from graphlens.schema import confidence_name

    edges = injection.bean_injections(bean_graph(spark, d), qualifiers=False)
    return edges.select("src", "dst", confidence_name(F.col("confidence")).alias("confidence"))


def service_graph(spark, d):
    customer, supplier, part = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "part")
    param = """array(named_struct('name', 'a', 'type', concat('I', c_nationkey), 'annotations', array('FromKeyedServices'), 'qualifier', c_mktsegment),
      named_struct('name', 'b', 'type', concat('IRepo<', c_custkey, '>'), 'annotations', array(''), 'qualifier', ''),
      named_struct('name', 'c', 'type', concat('Missing', c_custkey), 'annotations', array(''), 'qualifier', ''))"""
    nodes = [
        customer.selectExpr("concat('app.C', c_custkey) AS fqn", "concat('C', c_custkey) AS name", "'CLASS' AS kind"),
        customer.selectExpr("concat('app.C', c_custkey, '.new') AS fqn", "'new' AS name", "'FUNCTION' AS kind", "true AS is_constructor", f"{param} AS params"),
        supplier.selectExpr("concat('app.S', s_suppkey) AS fqn", "concat('S', s_suppkey) AS name", "'CLASS' AS kind"),
        table(spark, d, "nation").selectExpr("concat('app.I', n_nationkey) AS fqn", "concat('I', n_nationkey) AS name", "'INTERFACE' AS kind"),
        part.selectExpr("concat('app.', p_type, 'Repository') AS fqn", "concat(p_type, 'Repository') AS name", "'CLASS' AS kind").distinct(),
        part.selectExpr("'app.IRepo' AS fqn", "'IRepo' AS name", "'INTERFACE' AS kind").distinct(),
    ]
    edges = [customer.selectExpr("concat('app.C', c_custkey) AS src", "concat('app.C', c_custkey, '.new') AS dst", "'CONTAINS' AS kind")]
    registrations = (
        supplier.selectExpr("concat('I', s_nationkey) AS interface", "concat('S', s_suppkey) AS implementation", "CASE WHEN s_acctbal > 5000 THEN 'BUILDING' END AS key", "s_suppkey AS seq")
        .union(part.selectExpr("'IRepo<>' AS interface", "concat(p_type, 'Repository<>') AS implementation", "CAST(NULL AS STRING) AS key", "p_partkey + 1000000000 AS seq"))
    )
    return build(nodes, edges), registrations


LAST_SERVICE = """plain AS (SELECT s_nationkey AS n, max(s_suppkey) AS s FROM supplier WHERE s_acctbal <= 5000 GROUP BY 1),
  keyed AS (SELECT s_nationkey AS n, max(s_suppkey) AS s FROM supplier WHERE s_acctbal > 5000 GROUP BY 1),
  repo AS (SELECT max_by(p_type, p_partkey) AS t FROM part)"""


@query(
    "jn21_constructor_injection",
    f"""WITH {LAST_SERVICE} SELECT 'app.C' || c_custkey AS src, 'app.S' || CASE WHEN c_mktsegment = 'BUILDING' THEN coalesce(k.s, p.s) ELSE p.s END AS dst, 'HIGH' AS confidence
    FROM customer LEFT JOIN plain p ON p.n = c_nationkey LEFT JOIN keyed k ON k.n = c_nationkey
    WHERE CASE WHEN c_mktsegment = 'BUILDING' THEN coalesce(k.s, p.s) ELSE p.s END IS NOT NULL
    UNION ALL SELECT 'app.C' || c_custkey, 'app.' || t || 'Repository', 'MEDIUM' FROM customer, repo""",
)
def _(spark, d):
    from graphlens.schema import confidence_name

    graph, registrations = service_graph(spark, d)
    edges = injection.constructor_injections(graph, registrations)
    return edges.select("src", "dst", confidence_name(F.col("confidence")).alias("confidence"))


@query(
    "jn48_service_registrations",
    """SELECT 'app.I' || s_nationkey AS src, 'app.S' || s_suppkey AS dst FROM supplier UNION SELECT 'app.IRepo', 'app.' || p_type || 'Repository' FROM part""",
)
def _(spark, d):
    return injection.registration_edges(*service_graph(spark, d)).select("src", "dst")


@query(
    "jn48_registration_layers",
    """SELECT 'app.S' || s_suppkey AS fqn, 'Business Logic' AS layer FROM supplier UNION SELECT 'app.' || p_type || 'Repository', 'Data Access' FROM part""",
)
def _(spark, d):
    return injection.registration_layers(*service_graph(spark, d))


@query(
    "jn34_function_dependencies",
    """WITH p AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'm' || c_nationkey || '.get_db' WHEN 'AUTOMOBILE' THEN 'm3.get_db' WHEN 'FURNITURE' THEN 'm0.only' END AS dep, c_nationkey FROM customer)
    SELECT dep AS src, 'm' || c_nationkey || '.h' || c_custkey AS dst FROM p WHERE dep IS NOT NULL""",
)
def _(spark, d):
    ref = "CASE c_mktsegment WHEN 'BUILDING' THEN 'Depends(get_db)' WHEN 'AUTOMOBILE' THEN 'Depends( m3.get_db )' WHEN 'FURNITURE' THEN 'Depends(only)' ELSE 'Depends(nothing)' END"
    handlers = table(spark, d, "customer").selectExpr(
        "concat('m', c_nationkey, '.h', c_custkey) AS fqn", "'FUNCTION' AS kind", "'python' AS language",
        f"array(named_struct('name', 'db', 'type', '', 'annotations', array(''), 'qualifier', {ref})) AS params",
    )
    deps = table(spark, d, "nation").selectExpr("concat('m', n_nationkey, '.get_db') AS fqn", "'FUNCTION' AS kind", "'python' AS language", "n_nationkey AS seq")
    only = table(spark, d, "nation").filter("n_nationkey = 0").selectExpr("'m0.only' AS fqn", "'FUNCTION' AS kind", "'python' AS language")
    graph = build([handlers, deps, only], [handlers.selectExpr("fqn AS src", "fqn AS dst", "'CALLS' AS kind")])
    return injection.function_dependencies(graph).select("src", "dst")


# --- messages ----------------------------------------------------------------------------------


def event_graph(spark, d):
    orders, part = table(spark, d, "orders"), table(spark, d, "part")
    publishers = orders.selectExpr("concat('app.P', o_orderkey) AS fqn", "'FUNCTION' AS kind")
    listeners = part.selectExpr(
        "concat('app.L', p_partkey) AS fqn", "'FUNCTION' AS kind", "array('EventListener') AS annotations",
        "CASE WHEN p_size > 25 THEN map('EventListener', concat('com.ev.E', p_partkey, 'Event.class')) END AS annotation_args",
        "array(named_struct('name', 'e', 'type', concat(p_name, 'Event<T>'), 'annotations', array(''), 'qualifier', '')) AS params",
    )
    classes = part.selectExpr("concat('com.ev.E', p_partkey, 'Event') AS fqn", "concat('E', p_partkey, 'Event') AS name", "'CLASS' AS kind")
    kinds = table(spark, d, "lineitem")
    calls = orders.selectExpr("concat('app.P', o_orderkey) AS src", "CASE WHEN o_orderstatus = 'P' THEN 'x.save' ELSE 'bus.publishEvent' END AS dst", "'CALLS' AS kind", "0 AS seq")
    built = kinds.selectExpr("concat('app.P', l_orderkey) AS src", "concat('com.other.E', l_partkey, CASE WHEN l_quantity > 10 THEN 'Event' ELSE 'Thing' END, '.<init>') AS dst", "'CALLS' AS kind", "l_partkey AS seq")
    return build([publishers, listeners, classes], [calls, built])


EVENTS = """pub AS (SELECT l_orderkey AS o, min(l_partkey) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_quantity > 10 AND o_orderstatus <> 'P' GROUP BY 1),
  lis AS (SELECT p_partkey AS p, p_partkey AS t, p_size > 25 AS stated, p_name FROM part)"""


@query(
    "jn22_application_events",
    f"""WITH {EVENTS} SELECT 'app.P' || o AS src, 'app.L' || p AS dst, 'PRODUCES' AS kind FROM pub JOIN lis ON lis.t = pub.t AND stated
    UNION ALL SELECT 'app.L' || p, 'com.ev.E' || t || 'Event', 'CONSUMES' FROM lis WHERE stated""",
)
def _(spark, d):
    return messaging.application_events(event_graph(spark, d)).edges.select("src", "dst", "kind")


def broker_graph(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    listeners = customer.selectExpr(
        "concat('app.L', c_custkey, '.on') AS fqn", "'FUNCTION' AS kind",
        "CASE c_mktsegment WHEN 'BUILDING' THEN array('KafkaListener') WHEN 'FURNITURE' THEN array('RabbitListener', 'JmsListener') ELSE array('Other') END AS annotations",
        "map('KafkaListener', concat('{\"t', c_nationkey, '\", \"all\"}'), 'RabbitListener', concat('q', c_nationkey), 'JmsListener', 'j') AS annotation_args",
    )
    senders = orders.selectExpr(
        "concat('app.S', o_custkey, '.m', o_orderkey) AS fqn", "'FUNCTION' AS kind", "array('select 1 from x', concat('t', o_custkey % 25)) AS tagged_strings"
    )
    fields = customer.filter("c_acctbal > 0").selectExpr("concat('app.S', c_custkey, '.tpl') AS fqn", "'FIELD' AS kind", "'RabbitTemplate<K, V>' AS type")
    calls = orders.selectExpr(
        "concat('app.S', o_custkey, '.m', o_orderkey) AS src",
        "CASE o_orderstatus WHEN 'O' THEN 'org.KafkaTemplate.send' WHEN 'F' THEN 'tpl.convertAndSend' ELSE 'x.save' END AS dst", "'CALLS' AS kind",
    )
    return build([listeners, senders, fields], [calls])


CONSUMED = """con AS (SELECT c_custkey AS c, 'kafka' AS broker, unnest(['t' || c_nationkey, 'all']) AS topic FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT c_custkey, 'rabbitmq', 'q' || c_nationkey FROM customer WHERE c_mktsegment = 'FURNITURE' UNION ALL SELECT c_custkey, 'jms', 'j' FROM customer WHERE c_mktsegment = 'FURNITURE')"""
PRODUCED = """pro AS (SELECT o_custkey AS c, o_orderkey AS o, CASE o_orderstatus WHEN 'O' THEN 'kafka' ELSE 'rabbitmq' END AS broker, 't' || (o_custkey % 25) AS topic
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' OR (o_orderstatus = 'F' AND c_acctbal > 0))"""


@query("jn24_broker_consumers", f"WITH {CONSUMED} SELECT 'app.L' || c || '.on' AS fqn, topic, broker FROM con")
def _(spark, d):
    return messaging.broker_consumers(broker_graph(spark, d))


@query("jn23_broker_producers", f"WITH {PRODUCED} SELECT 'app.S' || c || '.m' || o AS fqn, topic, broker FROM pro")
def _(spark, d):
    return messaging.broker_producers(broker_graph(spark, d))


@query(
    "jn24_broker_topics",
    f"WITH {CONSUMED}, {PRODUCED} SELECT 'topic:' || broker || ':' || topic AS fqn, broker || '://' || topic AS name FROM con UNION SELECT 'topic:' || broker || ':' || topic, broker || '://' || topic FROM pro",
)
def _(spark, d):
    return messaging.broker_messages(broker_graph(spark, d)).nodes.select("fqn", "name")


def task_graph(spark, d):
    part = table(spark, d, "part")
    tasks = part.selectExpr(
        "concat('proj.', p_brand, '.t', p_size) AS fqn", "'FUNCTION' AS kind", "'python' AS language", "p_partkey AS seq",
        "CASE p_type WHEN 'PROMO' THEN array('other') WHEN 'SMALL' THEN array('x', '@shared_task') ELSE array(concat('app.task(queue=\"', p_type, '\")')) END AS annotations",
    )
    from graphlens.functions.scale import first_by

    tasks = first_by(tasks, ["fqn"], ["seq"])
    calls = table(spark, d, "lineitem").join(part, F.expr("l_partkey = p_partkey")).selectExpr(
        "concat('c', l_orderkey) AS src",
        "CASE l_returnflag WHEN 'R' THEN concat('proj.', p_brand, '.t', p_size, '.delay') WHEN 'A' THEN concat('t', p_size, '.apply_async') ELSE concat('zz.t', p_size, '.delay') END AS dst", "'CALLS' AS kind",
    )
    return build([tasks], [calls])


TASKS = """task AS (SELECT b, z, t, CASE t WHEN 'SMALL' THEN 'celery' ELSE t END AS queue, k FROM (SELECT p_brand AS b, p_size AS z, min_by(p_type, p_partkey) AS t, min(p_partkey) AS k FROM part GROUP BY 1, 2) WHERE t <> 'PROMO'),
  bare AS (SELECT z, min_by(queue, k) AS queue FROM task GROUP BY 1)"""


@query("jn26_task_consumers", f"WITH {TASKS} SELECT 'proj.' || b || '.t' || z AS fqn, queue FROM task")
def _(spark, d):
    return messaging.task_functions(task_graph(spark, d)).select("fqn", "queue")


@query(
    "jn25_task_triggers",
    f"""WITH {TASKS} SELECT DISTINCT 'c' || l_orderkey AS src, 'queue::' || task.queue AS dst FROM lineitem JOIN part ON l_partkey = p_partkey JOIN task ON b = p_brand AND z = p_size WHERE l_returnflag = 'R'
    UNION SELECT DISTINCT 'c' || l_orderkey, 'queue::' || bare.queue FROM lineitem JOIN part ON l_partkey = p_partkey JOIN bare ON z = p_size WHERE l_returnflag = 'A'""",
)
def _(spark, d):
    g = task_graph(spark, d)
    return messaging.task_triggers(g, messaging.task_functions(g)).select("src", "dst")


def schedule_graph(spark, d):
    nodes = table(spark, d, "customer").selectExpr(
        "concat('app.K', c_nationkey, '.m', c_custkey) AS fqn", "'FUNCTION' AS kind",
        "CASE c_mktsegment WHEN 'BUILDING' THEN array('Scheduled') WHEN 'FURNITURE' THEN array('Async') WHEN 'MACHINERY' THEN array('Scheduled') ELSE array('X') END AS annotations",
        "CASE c_mktsegment WHEN 'BUILDING' THEN map('Scheduled', '0 0 * * *') WHEN 'MACHINERY' THEN map('fixedRate', '5000', 'zone', 'UTC', 'noise', '1') WHEN 'FURNITURE' THEN map('Async', 'pool') END AS annotation_args",
    )
    calls = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).selectExpr("concat('o', o_orderkey) AS src", "concat('app.K', c_nationkey, '.m', c_custkey) AS dst", "'CALLS' AS kind")
    return build([nodes], [calls])


@query(
    "jn46_schedules",
    """SELECT 'app.K' || c_nationkey || '.m' || c_custkey AS fqn, CASE c_mktsegment WHEN 'FURNITURE' THEN 'async' ELSE 'scheduled' END AS kind,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'cron=0 0 * * *' WHEN 'MACHINERY' THEN 'fixedRate=5000,zone=UTC' ELSE 'executor=pool' END AS metadata FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')""",
)
def _(spark, d):
    points = messaging.schedules(schedule_graph(spark, d)).entry_points
    text = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return points.select("fqn", "kind", text.alias("metadata"))


@query("jn46_async_calls", "SELECT 'o' || o_orderkey AS src, 'app.K' || c_nationkey || '.m' || c_custkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'FURNITURE'")
def _(spark, d):
    return messaging.async_calls(schedule_graph(spark, d))


# --- endpoints -----------------------------------------------------------------------------------


def controller_graph(spark, d):
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    classes = nation.selectExpr(
        "concat('web.N', n_nationkey) AS fqn", "concat('N', n_nationkey) AS name", "'CLASS' AS kind", "CASE WHEN n_regionkey = 0 THEN array('Service') ELSE array('RestController') END AS annotations",
        "map('RequestMapping', concat('/n', n_nationkey, '/')) AS annotation_args",
    )
    methods = customer.selectExpr(
        "concat('web.N', c_nationkey, '.m', c_custkey) AS fqn", "concat('m', c_custkey) AS name", "'FUNCTION' AS kind",
        "CASE c_mktsegment WHEN 'BUILDING' THEN array('GetMapping') WHEN 'FURNITURE' THEN array('PostMapping', 'X') WHEN 'MACHINERY' THEN array('RequestMapping') ELSE array('X') END AS annotations",
        "CASE c_mktsegment WHEN 'BUILDING' THEN map('GetMapping', concat('c/', c_custkey)) WHEN 'MACHINERY' THEN map('RequestMapping', '/any', 'method', 'put') ELSE map('x', 'y') END AS annotation_args",
    )
    contains = customer.selectExpr("concat('web.N', c_nationkey) AS src", "concat('web.N', c_nationkey, '.m', c_custkey) AS dst", "'CONTAINS' AS kind")
    return build([classes, methods], [contains])


MAPPED = """m AS (SELECT 'web.N' || c_nationkey AS cls, 'web.N' || c_nationkey || '.m' || c_custkey AS fn, CASE c_mktsegment WHEN 'BUILDING' THEN 'GET' WHEN 'FURNITURE' THEN 'POST' ELSE 'PUT' END AS verb,
    '/n' || c_nationkey || CASE c_mktsegment WHEN 'BUILDING' THEN '/c/' || c_custkey WHEN 'FURNITURE' THEN '' ELSE '/any' END AS url
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0 AND c_mktsegment IN ('BUILDING', 'FURNITURE', 'MACHINERY'))"""


@query(
    "jn33_annotated_endpoints",
    f"""WITH {MAPPED} SELECT fn AS src, 'endpoint:' || verb || ':' || url AS dst, 'HANDLES' AS kind FROM m UNION SELECT cls, 'endpoint:' || verb || ':' || url, 'EXPOSES' FROM m""",
)
def _(spark, d):
    return endpoints.annotated_controllers(controller_graph(spark, d)).edges.select("src", "dst", "kind")


@query("jn33_endpoint_nodes", f"WITH {MAPPED} SELECT DISTINCT 'endpoint:' || verb || ':' || url AS fqn, verb || ' ' || url AS name FROM m")
def _(spark, d):
    return endpoints.annotated_controllers(controller_graph(spark, d)).nodes.select("fqn", "name")


def server_graph(spark, d):
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    classes = nation.selectExpr("concat('srv.N', n_nationkey) AS fqn", "concat('N', n_nationkey, 'Controller') AS name", "'CLASS' AS kind", "'ControllerBase' AS base_class", "map('', 'api/[controller]/[action]') AS annotation_args")
    methods = customer.selectExpr(
        "concat('srv.N', c_nationkey, '.M', c_custkey) AS fqn", "concat('M', c_custkey) AS name", "'FUNCTION' AS kind",
        "CASE c_mktsegment WHEN 'BUILDING' THEN array('HttpGet') WHEN 'FURNITURE' THEN array('HttpPost', 'Route') WHEN 'MACHINERY' THEN array('HttpPut', 'Route') ELSE array('X') END AS annotations",
        "CASE c_mktsegment WHEN 'BUILDING' THEN map('HttpGet', '{id:int}/[action]') WHEN 'FURNITURE' THEN map('Route', '~/abs/{key?}') WHEN 'MACHINERY' THEN map('Route', 'rel') END AS annotation_args",
        "array(named_struct('name', 'x', 'type', concat('D', c_nationkey), 'annotations', array(CASE WHEN c_acctbal > 0 THEN 'FromBody' ELSE 'Other' END), 'qualifier', '')) AS params",
    )
    dtos = nation.selectExpr("concat('srv.D', n_nationkey) AS fqn", "concat('D', n_nationkey) AS name", "'CLASS' AS kind")
    contains = customer.selectExpr("concat('srv.N', c_nationkey) AS src", "concat('srv.N', c_nationkey, '.M', c_custkey) AS dst", "'CONTAINS' AS kind")
    return build([classes, methods, dtos], [contains])


SERVED = """s AS (SELECT 'srv.N' || c_nationkey || '.M' || c_custkey AS fn, c_nationkey, c_acctbal, CASE c_mktsegment WHEN 'BUILDING' THEN 'GET' WHEN 'FURNITURE' THEN 'POST' ELSE 'PUT' END AS verb,
    CASE c_mktsegment WHEN 'FURNITURE' THEN '/abs/:key' ELSE '/api/n' || c_nationkey || '/m' || c_custkey || CASE c_mktsegment WHEN 'BUILDING' THEN '/:id/m' || c_custkey ELSE '/rel' END END AS url
  FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE', 'MACHINERY'))"""


@query("jn33_attribute_endpoints", f"WITH {SERVED} SELECT DISTINCT fn AS src, 'endpoint:' || verb || ':' || url AS dst FROM s")
def _(spark, d):
    return endpoints.server_controllers(server_graph(spark, d)).edges.filter("kind = 'HANDLES'").select("src", "dst")


@query("jn49_bound_types", f"WITH {SERVED} SELECT 'endpoint:' || verb || ':' || url AS src, 'srv.D' || c_nationkey AS dst FROM s WHERE c_acctbal > 0")
def _(spark, d):
    return endpoints.server_controllers(server_graph(spark, d)).edges.filter("kind = 'DEPENDS_ON'").select("src", "dst")


@query(
    "jn33_minimal_endpoints",
    """SELECT 'P.f' || c_custkey AS src, 'endpoint:' || CASE c_mktsegment WHEN 'BUILDING' THEN 'GET' ELSE 'POST' END || ':' ||
      CASE WHEN c_acctbal > 0 THEN '/n' || c_nationkey ELSE '' END || CASE c_custkey % 2 WHEN 0 THEN '/:id' ELSE '/x/' || c_custkey END AS dst FROM customer""",
)
def _(spark, d):
    groups = table(spark, d, "nation").selectExpr("concat('g', n_nationkey) AS group_name", "concat('/n', n_nationkey) AS prefix")
    calls = table(spark, d, "customer").selectExpr(
        "'P' AS owner", "concat('P.f', c_custkey) AS handler", "CASE c_mktsegment WHEN 'BUILDING' THEN 'GET' ELSE 'POST' END AS verb",
        "CASE c_custkey % 2 WHEN 0 THEN '{id:int}' ELSE concat('/x/', c_custkey) END AS path", "CASE WHEN c_acctbal > 0 THEN concat('g', c_nationkey) END AS group_name",
    )
    return endpoints.mapped_handlers(groups, calls).edges.filter("kind = 'HANDLES'").select("src", "dst")


@query(
    "jn33_remote_endpoints",
    """SELECT 'rpc.N' || c_nationkey || '.M' || c_custkey AS src, 'endpoint:GRPC:/N' || c_nationkey || '/M' || c_custkey AS dst
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND n_regionkey < 4""",
)
def _(spark, d):
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    classes = nation.selectExpr("concat('rpc.N', n_nationkey) AS fqn", "concat('N', n_nationkey, 'Service') AS name", "'CLASS' AS kind", "concat('N', n_nationkey, '.N', n_nationkey, 'Base') AS base_class")
    methods = customer.selectExpr(
        "concat('rpc.N', c_nationkey, '.M', c_custkey) AS fqn", "concat('M', c_custkey) AS name", "'FUNCTION' AS kind", "map('is_override', CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END) AS props"
    )
    contains = customer.selectExpr("concat('rpc.N', c_nationkey) AS src", "concat('rpc.N', c_nationkey, '.M', c_custkey) AS dst", "'CONTAINS' AS kind")
    registered = nation.filter("n_regionkey < 4").selectExpr("concat('N', n_nationkey, 'Service') AS name")
    return endpoints.remote_services(build([classes, methods], [contains]), registered).edges.filter("kind = 'HANDLES'").select("src", "dst")


def hub_edges(spark, d):
    """Hubs of every second nation are mapped; their clients' functions are events."""
    nation, customer, supplier = table(spark, d, "nation"), table(spark, d, "customer"), table(spark, d, "supplier")
    hubs = nation.selectExpr("concat('hub.N', n_nationkey) AS fqn", "concat('N', n_nationkey, 'Hub') AS name", "'CLASS' AS kind", "CASE WHEN n_regionkey = 0 THEN 'Hub' ELSE concat('Hub<C', n_nationkey, '>') END AS base_class")
    methods = customer.selectExpr(
        "concat('hub.N', c_nationkey, '.M', c_custkey) AS fqn", "CASE WHEN c_custkey % 50 = 0 THEN 'OnConnectedAsync' ELSE concat('M', c_custkey) END AS name", "'FUNCTION' AS kind"
    )
    clients = nation.selectExpr("concat('hub.C', n_nationkey) AS fqn", "concat('C', n_nationkey) AS name", "'INTERFACE' AS kind")
    told = supplier.selectExpr("concat('hub.C', s_nationkey, '.E', s_suppkey) AS fqn", "concat('E', s_suppkey) AS name", "'FUNCTION' AS kind")
    contains = [
        customer.selectExpr("concat('hub.N', c_nationkey) AS src", "concat('hub.N', c_nationkey, '.M', c_custkey) AS dst", "'CONTAINS' AS kind"),
        supplier.selectExpr("concat('hub.C', s_nationkey) AS src", "concat('hub.C', s_nationkey, '.E', s_suppkey) AS dst", "'CONTAINS' AS kind"),
    ]
    mapped = nation.filter("n_nationkey % 2 = 0").selectExpr("concat('N', n_nationkey, 'Hub') AS name", "concat('/hub/', n_nationkey) AS url")
    return endpoints.socket_hubs(build([hubs, methods, clients, told], contains), mapped).edges


@query(
    "jn33_hub_endpoints",
    "SELECT 'hub.N' || c_nationkey || '.M' || c_custkey AS src, 'endpoint:WS:/hub/' || c_nationkey AS dst FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey % 50 <> 0",
)
def _(spark, d):
    return hub_edges(spark, d).filter("kind = 'HANDLES'").select("src", "dst")


@query(
    "jn33_hub_events",
    """SELECT 'hub.N' || n_nationkey AS src, 'endpoint:WS:/hub/' || n_nationkey AS dst, 'E' || s_suppkey AS event
    FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 2 = 0 AND n_regionkey <> 0""",
)
def _(spark, d):
    return hub_edges(spark, d).filter("kind = 'PRODUCES'").selectExpr("src", "dst", "props['event'] AS event")


def python_web(spark, d):
    """Decorated functions, routers, blueprints and resources; files register them."""
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    functions = customer.selectExpr(
        "concat('py.m', c_nationkey, '.f', c_custkey) AS fqn", "concat('f', c_custkey) AS name", "'FUNCTION' AS kind", "'python' AS language",
        "CASE c_mktsegment WHEN 'BUILDING' THEN array(concat('r', c_nationkey, '.get(\"/x/', c_custkey, '\")')) WHEN 'FURNITURE' THEN array(concat('bp', c_nationkey, '.route(\"/b', c_custkey, '\", methods=[\"get\", \"POST\"])')) "
        "WHEN 'MACHINERY' THEN array(concat('app.route(\"/a', c_custkey, '\")')) ELSE array('x') END AS annotations",
    )
    fields = nation.selectExpr("concat('py.m', n_nationkey, '.r', n_nationkey) AS fqn", "concat('r', n_nationkey) AS name", "'FIELD' AS kind", "'python' AS language", "concat('APIRouter(prefix=\"/n', n_nationkey, '\")') AS value")
    blueprints = nation.selectExpr("concat('py.m', n_nationkey, '.bp', n_nationkey) AS fqn", "concat('bp', n_nationkey) AS name", "'FIELD' AS kind", "'python' AS language", "concat('Blueprint(\"b\", __name__, url_prefix=\"/ctor', n_nationkey, '\")') AS value")
    rules_ = customer.filter("c_acctbal < 0").selectExpr("concat('py.m', c_nationkey, '.rule', c_custkey) AS fqn", "'rule' AS name", "'FIELD' AS kind", "'python' AS language", "concat('add_url_rule(\"/u', c_custkey, '\", view_func=f', c_custkey, ')') AS value")
    resources = nation.selectExpr("concat('py.Res', n_nationkey) AS fqn", "concat('Res', n_nationkey) AS name", "'CLASS' AS kind", "'python' AS language")
    verbs = nation.selectExpr("concat('py.Res', n_nationkey, '.get') AS fqn", "'get' AS name", "'FUNCTION' AS kind", "'python' AS language")
    edges = [
        nation.selectExpr("concat('py.Res', n_nationkey) AS src", "'flask_restful.Resource' AS dst", "'INHERITS' AS kind"),
        nation.selectExpr("concat('py.Res', n_nationkey) AS src", "concat('py.Res', n_nationkey, '.get') AS dst", "'CONTAINS' AS kind"),
    ]
    files = nation.selectExpr(
        "concat('f', n_nationkey, '.py') AS path",
        "concat(CASE WHEN n_regionkey > 1 THEN concat('app.register_blueprint(bp', n_nationkey, ', url_prefix=\"/reg', n_nationkey, '/\")') ELSE '' END, "
        "' api = Api(app, prefix=\"/v1\") ', CASE WHEN n_regionkey < 3 THEN concat('api.add_resource(Res', n_nationkey, ', \"/res', n_nationkey, '\")') ELSE '' END) AS text",
    )
    return build([functions, fields, blueprints, rules_, resources, verbs], edges), files


@query(
    "jn33_decorated_endpoints",
    "SELECT 'py.m' || c_nationkey || '.f' || c_custkey AS src, 'GET:/n' || c_nationkey || '/x/' || c_custkey AS dst FROM customer WHERE c_mktsegment = 'BUILDING'",
)
def _(spark, d):
    return endpoints.decorated_routes(python_web(spark, d)[0]).edges.select("src", "dst")


@query(
    "jn35_blueprint_endpoints",
    """SELECT 'py.m' || c_nationkey || '.f' || c_custkey AS src, verb || ':' || CASE WHEN n_regionkey > 1 THEN '/reg' ELSE '/ctor' END || c_nationkey || '/b' || c_custkey AS dst
    FROM customer JOIN nation ON c_nationkey = n_nationkey, (SELECT unnest(['GET', 'POST']) AS verb) WHERE c_mktsegment = 'FURNITURE'
    UNION ALL SELECT 'py.m' || c_nationkey || '.f' || c_custkey, 'GET:/a' || c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'
    UNION ALL SELECT 'py.m' || c_nationkey || '.f' || c_custkey, 'GET:/u' || c_custkey FROM customer WHERE c_acctbal < 0""",
)
def _(spark, d):
    return endpoints.blueprint_routes(*python_web(spark, d)).edges.select("src", "dst")


@query("jn35_resource_endpoints", "SELECT 'py.Res' || n_nationkey || '.get' AS src, 'GET:/v1/res' || n_nationkey AS dst FROM nation WHERE n_regionkey < 3")
def _(spark, d):
    return endpoints.resource_routes(*python_web(spark, d)).edges.select("src", "dst")


def viewset_graph(spark, d):
    customer = table(spark, d, "customer")
    sets = customer.selectExpr("concat('v.V', c_custkey) AS fqn", "concat('V', c_custkey, 'ViewSet') AS name", "'CLASS' AS kind")
    models = customer.selectExpr("concat('m.M', c_custkey) AS fqn", "concat('M', c_custkey) AS name", "'CLASS' AS kind")
    serializers = customer.selectExpr("concat('z.Z', c_custkey) AS fqn", "concat('Z', c_custkey) AS name", "'CLASS' AS kind")
    fields = [
        customer.filter("c_mktsegment = 'BUILDING'").selectExpr("concat('v.V', c_custkey, '.queryset') AS fqn", "'queryset' AS name", "'FIELD' AS kind", "concat('M', c_custkey, '.objects.all()') AS value"),
        customer.selectExpr("concat('v.V', c_custkey, '.serializer_class') AS fqn", "'serializer_class' AS name", "'FIELD' AS kind", "concat('Z', c_custkey) AS value"),
        customer.filter("c_mktsegment = 'FURNITURE'").selectExpr("concat('z.Z', c_custkey, '._meta_model') AS fqn", "'_meta_model' AS name", "'FIELD' AS kind", "concat('M', c_custkey) AS value"),
    ]
    edges = [
        customer.selectExpr("concat('v.V', c_custkey) AS src", "CASE WHEN c_acctbal > 0 THEN 'rest.viewsets.ModelViewSet' ELSE 'rest.viewsets.ReadOnlyModelViewSet' END AS dst", "'INHERITS' AS kind"),
        customer.filter("c_mktsegment = 'BUILDING'").selectExpr("concat('v.V', c_custkey) AS src", "concat('v.V', c_custkey, '.queryset') AS dst", "'CONTAINS' AS kind"),
        customer.selectExpr("concat('v.V', c_custkey) AS src", "concat('v.V', c_custkey, '.serializer_class') AS dst", "'CONTAINS' AS kind"),
        customer.filter("c_mktsegment = 'FURNITURE'").selectExpr("concat('z.Z', c_custkey) AS src", "concat('z.Z', c_custkey, '._meta_model') AS dst", "'CONTAINS' AS kind"),
        customer.selectExpr("concat('m.M', c_custkey) AS src", "concat('table:', c_custkey) AS dst", "'MAPS_TO' AS kind"),
    ]
    return build([sets, models, serializers, *fields], edges)


@query(
    "jn29_viewset_links",
    """WITH v AS (SELECT c_custkey AS k, c_acctbal > 0 AS writes, c_mktsegment IN ('BUILDING', 'FURNITURE') AS known, CASE c_mktsegment WHEN 'BUILDING' THEN 'm' ELSE 'v' END || c_custkey || 's' AS res FROM customer)
    SELECT 'v.V' || k AS src, 'm.M' || k AS dst, 'MANAGES' AS kind FROM v WHERE known UNION ALL SELECT 'v.V' || k, 'table:' || k, 'READS' FROM v WHERE known
    UNION ALL SELECT 'v.V' || k, 'table:' || k, 'WRITES' FROM v WHERE known AND writes
    UNION ALL SELECT 'v.V' || k, a || ':/' || res || '/', 'HANDLES' FROM v, (SELECT unnest(['GET', 'POST']) AS a) WHERE writes OR a = 'GET'
    UNION ALL SELECT 'v.V' || k, a || ':/' || res || '/{pk}/', 'HANDLES' FROM v, (SELECT unnest(['GET', 'PUT', 'PATCH', 'DELETE']) AS a) WHERE writes OR a = 'GET'""",
)
def _(spark, d):
    return endpoints.viewsets(viewset_graph(spark, d)).edges.select("src", "dst", "kind")


@query(
    "jn30_url_patterns",
    """SELECT 'ANY:/r' || n_regionkey || '/p' || n_nationkey AS src, CASE WHEN n_regionkey = 0 THEN 'blog' || n_nationkey || '.views.V' || n_nationkey ELSE 'other.W' || n_nationkey END AS dst FROM nation""",
)
def _(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    fields = nation.selectExpr(
        "concat('blog', n_nationkey, '.urls.urlpatterns') AS fqn", "'urlpatterns' AS name", "'FIELD' AS kind",
        "concat('[path(\"p', n_nationkey, '\", ', CASE WHEN n_regionkey = 0 THEN 'V' ELSE 'W' END, n_nationkey, '.as_view()), path(\"x\", include(\"y\"))]') AS value",
    )
    views = nation.selectExpr(
        "CASE WHEN n_regionkey = 0 THEN concat('blog', n_nationkey, '.views.V', n_nationkey) ELSE concat('other.W', n_nationkey) END AS fqn",
        "concat(CASE WHEN n_regionkey = 0 THEN 'V' ELSE 'W' END, n_nationkey) AS name", "'CLASS' AS kind",
    )
    graph = build([fields, views], [views.selectExpr("fqn AS src", "fqn AS dst", "'CALLS' AS kind")])
    includes = region.selectExpr("'root.urls' AS module", "concat('reg', r_regionkey, '.urls') AS included", "concat('/r', r_regionkey, '/') AS prefix").union(
        nation.selectExpr("concat('reg', n_regionkey, '.urls') AS module", "concat('blog', n_nationkey, '.urls') AS included", "'' AS prefix")
    )
    return endpoints.url_patterns(graph, endpoints.include_prefixes(includes)).edges.select("src", "dst")


# --- rule sets ---------------------------------------------------------------------------------


@query(
    "ext1_rule_application",
    f"WITH {MAPPED}, {SERVED} SELECT kind, count(*) AS edges FROM (SELECT 'HANDLES' AS kind FROM m UNION ALL SELECT DISTINCT 'EXPOSES' FROM m UNION ALL SELECT 'CONTAINS' FROM customer) GROUP BY 1",
)
def _(spark, d):
    graph, found = rules.apply_rules(controller_graph(spark, d), [endpoints.annotated_controllers, messaging.schedules])
    return graph.edges.withColumn("once", F.when(F.col("kind") == "EXPOSES", F.lit("x")).otherwise(F.concat_ws(">", "src", "dst"))).select("kind", "once").distinct().groupBy("kind").agg(F.count("*").alias("edges"))


@query("ext2_layer_later_wins", f"WITH {MAPPED} SELECT DISTINCT cls AS fqn, CASE WHEN n.n_regionkey > 2 THEN 'Later' ELSE 'Presentation' END AS layer FROM m JOIN nation n ON cls = 'web.N' || n_nationkey")
def _(spark, d):
    later = table(spark, d, "nation").filter("n_regionkey > 2").selectExpr("concat('web.N', n_nationkey) AS fqn", "'Later' AS layer")

    def relabel(graph):
        return rules.RuleResult(layers=later)

    _graph, found = rules.apply_rules(controller_graph(spark, d), [endpoints.annotated_controllers, relabel])
    return found.layers


@query("ext3_active_rules", "SELECT p_brand AS rule FROM part GROUP BY 1 HAVING max(p_size % 3 + 1) >= 2")
def _(spark, d):
    detections = table(spark, d, "part").selectExpr("p_brand AS rule", "p_size % 3 + 1 AS confidence")
    return rules.active(detections).select("rule").distinct()
