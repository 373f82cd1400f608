"""Cross-technology links over pages, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.functions import text
from graphlens.graph import Graph, edge_rows, node_rows
from graphlens.operators import link
from graphlens.plans.derived import shop_edges
from graphlens.plans.registry import query, table


def norm_sql(x: str) -> str:
    """The URL normalisation for the oracle."""
    path = f"split_part(regexp_replace({x}, '^https?://[^/]+', ''), '?', 1)"
    path = f"CASE WHEN starts_with({path}, '/') THEN {path} ELSE '/' || {path} END"
    path = f"regexp_replace({path}, '\\$\\{{[^}}]+\\}}|\\{{[^}}]+\\}}', ':param', 'g')"
    path = f"lower(regexp_replace({path}, ':[a-zA-Z_]\\w*', ':param', 'g'))"
    return f"CASE WHEN length({path}) = 1 THEN {path} ELSE regexp_replace({path}, '/+$', '') END"


TEMPLATE = "CASE WHEN contains(url, '?') THEN regexp_replace(split_part(url, '?', 1), '/[0-9]+$', '/{id}') ELSE url END"
VERB = "CASE WHEN url LIKE 'https%' THEN 'GET' ELSE 'POST' END"


@query("fn_normalize_url_path", f"SELECT page_id, {norm_sql('url')} AS path, {norm_sql(TEMPLATE)} AS template FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select(
        "page_id", text.normalize_url_path(F.col("url")).alias("path"), text.normalize_url_path(F.expr(TEMPLATE)).alias("template")
    )


def web_graph(spark, d):
    """Every page is an endpoint and a caller of its own URL and of the links in its text."""
    pages = table(spark, d, "pages")
    endpoints = pages.selectExpr(
        "concat('endpoint:', page_id) AS fqn", "'API_ENDPOINT' AS kind", f"{VERB} AS method", f"map('path', {TEMPLATE}) AS props", "page_id AS seq"
    )
    callers = pages.selectExpr(
        "concat('page:', page_id) AS fqn", "'FUNCTION' AS kind", "page_id AS seq",
        "concat(array(named_struct('method', 'get', 'url', url)), "
        "transform(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), h -> named_struct('method', 'post', 'url', h))) AS http_calls",
    )
    return Graph(node_rows(endpoints).unionByName(node_rows(callers)), edge_rows(shop_edges(spark, d).limit(0)))


HTTP = f"""ep AS (SELECT method, path, max_by(page_id, page_id) AS page_id, min(page_id) AS ord FROM (SELECT page_id, {VERB} AS method,
    {norm_sql(TEMPLATE)} AS path FROM pages) GROUP BY 1, 2),
  call AS (SELECT page_id, 'GET' AS method, url FROM pages
    UNION ALL SELECT page_id, 'POST', unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) FROM pages),
  norm AS (SELECT page_id, method, url, {norm_sql('url')} AS path FROM call),
  miss AS (SELECT DISTINCT method, path, string_split(trim(path, '/'), '/') AS s FROM norm n
    WHERE NOT EXISTS (SELECT 1 FROM ep WHERE ep.method = n.method AND ep.path = n.path)),
  cand AS (SELECT *, string_split(trim(path, '/'), '/') AS s FROM ep),
  loose AS (SELECT m.method, m.path, min_by(c.page_id, c.ord) AS target FROM miss m JOIN cand c ON c.method = m.method AND len(c.s) = len(m.s)
    WHERE len(list_filter(list_zip(c.s, m.s), lambda z: NOT (z[1] = z[2] OR z[1] = ':param' OR z[2] = ':param'))) = 0 GROUP BY 1, 2)"""


@query(
    "jn5_http_exact_links",
    f"""WITH {HTTP} SELECT 'page:' || n.page_id AS src, 'endpoint:' || e.page_id AS dst, url FROM norm n
    JOIN ep e ON e.method = n.method AND e.path = n.path""",
)
def _(spark, d):
    links = link.http_links(web_graph(spark, d)).filter("confidence = 3")
    return links.select("src", "dst", F.col("props")["url_pattern"].alias("url"))


@query(
    "jn6_http_parameter_links",
    f"""WITH {HTTP} SELECT 'page:' || n.page_id AS src, 'endpoint:' || l.target AS dst, url FROM norm n
    JOIN loose l ON l.method = n.method AND l.path = n.path""",
)
def _(spark, d):
    links = link.http_links(web_graph(spark, d)).filter("confidence = 2")
    return links.select("src", "dst", F.col("props")["url_pattern"].alias("url"))


PATTERN = """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '?-URGENT.O.' || c_custkey WHEN 'BUILDING' THEN '2-HIGH.*.' || c_custkey
  WHEN 'FURNITURE' THEN '*.[PO].' || c_custkey || '*' WHEN 'HOUSEHOLD' THEN '5-LOW.F.' || c_custkey ELSE '*-*.F.' || c_custkey END"""


def topic_graph(spark, d):
    """Orders publish, customers subscribe by name or by pattern."""
    producers = table(spark, d, "orders").selectExpr(
        "concat('f:', o_orderkey) AS fqn", "'FUNCTION' AS kind", "o_orderkey AS seq",
        "array(named_struct('topic', o_orderpriority || '.' || o_orderstatus || '.' || o_custkey, 'broker', "
        "CASE o_orderstatus WHEN 'O' THEN 'kafka' WHEN 'F' THEN 'rabbitmq' END)) AS mq_produces",
    )
    consumers = table(spark, d, "customer").selectExpr(
        "concat('g:', c_custkey) AS fqn", "'FUNCTION' AS kind", "c_custkey AS seq",
        f"array(named_struct('topic', {PATTERN}, 'broker', 'jms')) AS mq_consumes",
    )
    return Graph(node_rows(producers).unionByName(node_rows(consumers)), edge_rows(shop_edges(spark, d).limit(0)))


TOPIC = f"""prod AS (SELECT o_orderkey, o_orderpriority || '.' || o_orderstatus || '.' || o_custkey AS topic,
    CASE o_orderstatus WHEN 'O' THEN 'kafka' WHEN 'F' THEN 'rabbitmq' ELSE 'unknown' END AS broker FROM orders),
  cons AS (SELECT c_custkey, {PATTERN} AS pattern FROM customer),
  exact AS (SELECT * FROM cons WHERE NOT contains(pattern, '*') AND NOT contains(pattern, '?')),
  topic AS (SELECT topic, min_by(broker, ord) AS broker FROM (SELECT topic, broker, o_orderkey AS ord FROM prod
    UNION ALL SELECT pattern, 'jms', 1000000000000 + c_custkey FROM exact) GROUP BY 1)"""


@query("jn7_topics", f"WITH {TOPIC} SELECT 'topic:' || topic AS fqn, topic AS name, broker FROM topic")
def _(spark, d):
    return link.topic_links(topic_graph(spark, d)).nodes.select("fqn", "name", F.col("props")["broker_type"].alias("broker"))


@query(
    "jn7_topic_edges",
    f"""WITH {TOPIC} SELECT 'f:' || o_orderkey AS src, 'topic:' || topic AS dst, 'PRODUCES' AS kind, 'HIGH' AS confidence FROM prod
    UNION ALL SELECT 'g:' || c_custkey, 'topic:' || pattern, 'CONSUMES', 'HIGH' FROM exact
    UNION ALL SELECT 'g:' || c_custkey, 'topic:' || topic, 'CONSUMES', 'MEDIUM' FROM cons JOIN topic ON topic GLOB pattern
      WHERE contains(pattern, '*') OR contains(pattern, '?')""",
)
def _(spark, d):
    from graphlens.schema import confidence_name

    return link.topic_links(topic_graph(spark, d)).edges.select("src", "dst", "kind", confidence_name(F.col("confidence")).alias("confidence"))


@query(
    "fn_glob_match",
    f"""WITH {TOPIC} SELECT DISTINCT topic AS name, pattern FROM (SELECT DISTINCT topic FROM prod) JOIN cons ON topic GLOB pattern""",
)
def _(spark, d):
    g = topic_graph(spark, d)
    names = g.nodes.select(F.explode("mq_produces.topic").alias("name"))
    patterns = g.nodes.select(F.explode("mq_consumes.topic").alias("pattern"))
    return link.glob_matches(names, patterns)


def entity_graph(spark, d):
    """Customers and suppliers map to the parts they trade; the nation is the module."""
    line = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
    customer = table(spark, d, "customer")
    entity = "concat('com.app.m', c_nationkey, '.C', c_custkey)"
    nodes = customer.selectExpr(f"{entity} AS fqn", "'CLASS' AS kind", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' END AS module")
    tables = table(spark, d, "part").selectExpr("concat('table:', p_partkey) AS fqn", "p_name AS name", "'TABLE' AS kind")
    maps = line.join(customer, F.expr("o_custkey = c_custkey")).selectExpr(
        f"{entity} AS src", "concat('table:', l_partkey) AS dst", "'MAPS_TO' AS kind", "l_orderkey * 10 + l_linenumber AS seq"
    )
    return Graph(node_rows(nodes).unionByName(node_rows(tables)), edge_rows(maps))


SHARED = """m AS (SELECT DISTINCT l_partkey, p_name, 'com.app.m' || c_nationkey || '.C' || c_custkey AS entity,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' ELSE 'm' || c_nationkey END AS module
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = l_partkey),
  t AS (SELECT l_partkey FROM m GROUP BY 1 HAVING count(DISTINCT module) >= 2)"""


@query("jn8_shared_table_members", f"WITH {SHARED} SELECT 'table:' || l_partkey AS table_fqn, p_name AS table_name, module, entity FROM m WHERE l_partkey IN (SELECT l_partkey FROM t)")
def _(spark, d):
    return link.shared_table_members(entity_graph(spark, d)).drop("module_ord")


@query("jn8_shared_table_warnings", f"WITH {SHARED} SELECT DISTINCT p_name AS table_name, module FROM m WHERE l_partkey IN (SELECT l_partkey FROM t)")
def _(spark, d):
    return link.shared_table_warnings(link.shared_table_members(entity_graph(spark, d)))
