"""Text and statement rules on the spellings that real sources use."""

from fnmatch import fnmatchcase

import pytest
from pyspark.sql import functions as F

from graphlens.functions.text import field_constraints, glob_regex, glob_regex_column
from graphlens.operators import link
from graphlens.operators.rules import endpoints
from graphlens.operators.rules.schema_history import fold_schema, sql_lineage, statements

NAMES = ["xaz", "x]z", "x[z", "x^z", "xbz", "a.b", "aXb", "ab", "", "x-z", "x&z", "x\\z", "x[]z", "[!]ab", "cab", "a?b", "\nab"]
PATTERNS = ["x[]abc]z", "x[!]a]z", "x[^a]z", "x[a-c]z", "*ab*", "?-?", "x[", "[!]ab", "x[[]z", "x[&&]z", "x[\\]z", "a.b", "[ab]*", "", "*", "x[]z"]


def test_globs_agree_with_shell_rules(spark):
    wanted = {(n, p) for n in NAMES for p in PATTERNS if fnmatchcase(n, p)}
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    patterns = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    assert {tuple(r) for r in link.glob_matches(names, patterns).select("name", "pattern").collect()} == wanted
    pairs = spark.createDataFrame([(n, p) for n in NAMES for p in PATTERNS], "name string, pattern string")
    assert {tuple(r) for r in pairs.filter(F.rlike("name", glob_regex_column(F.col("pattern")))).collect()} == wanted
    fixed = {(n, p) for p in PATTERNS for (n,) in names.filter(F.col("name").rlike(glob_regex(p))).collect()}
    assert fixed == wanted


def test_last_keyword_of_a_field_wins(spark):
    df = spark.createDataFrame([("Field(default=1, gt=0, default=2)",)], "raw string")
    assert df.select(field_constraints(F.col("raw"))).first()[0]["default"] == "2"


def test_migrations(spark):
    files = spark.createDataFrame([
        ("V20240101120000__a.sql", "CREATE TABLE t2 (id INT PRIMARY KEY, note VARCHAR(10) DEFAULT 'a;b, (c', x INT); -- it's; done\nALTER TABLE t2 ADD COLUMN a INT, ADD COLUMN b DECIMAL(8, 2);"),
        ("V20240101120001__b.sql", 'ALTER TABLE "s"."t2" ADD COLUMN IF NOT EXISTS c TEXT DEFAULT \'--x\', ADD CONSTRAINT k UNIQUE (a)'),
    ], "name string, text string")
    columns, _, _ = fold_schema(statements(files))
    assert {(r["table"], r["column"], r["type"]) for r in columns.collect()} == {
        ("t2", "id", "INT"), ("t2", "note", "VARCHAR(10)"), ("t2", "x", "INT"), ("t2", "a", "INT"), ("t2", "b", "DECIMAL(8, 2)"), ("t2", "c", "TEXT"),
    }


@pytest.mark.parametrize("text, tables", [
    ("SELECT * FROM a, b x, c AS y WHERE x.i = 1", {"a", "b", "c"}),
    ("SELECT extract(year FROM created_at), 'FROM z' FROM \"x\".\"y\" JOIN s.t ON 1 = 1", {"y", "t"}),
    ("INSERT INTO t (a, b) SELECT a, b FROM u", {"t", "u"}),
    ("UPDATE t SET a = 1, b = 2 WHERE c IN (SELECT c FROM v, w)", {"t"}),
    ("DELETE FROM t WHERE a = 1", {"t"}),
    ("DELETE FROM t USING u WHERE t.i = u.i", {"t"}),
    ("WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c) SELECT * FROM C JOIN d ON 1 = 1", {"d"}),
    ("WITH a AS (SELECT * FROM b), c (x) AS MATERIALIZED (SELECT 1 FROM a, k) INSERT INTO t (p, q) SELECT * FROM c", {"b", "k", "t"}),
    ("SELECT * FROM a x JOIN b ON x.i = b.i, e", {"a", "b", "e"}),
    ("SELECT * FROM a, (SELECT 1 FROM z) x, d", {"a", "z", "d"}),
    ('SELECT * FROM "My Table" t, `s`.`From x`', {"My Table", "From x"}),
    ("SELECT * FROM a JOIN b ON a.x IS NOT DISTINCT FROM y WHERE x IS DISTINCT FROM z", {"a", "b"}),
    ("SELECT EXTRACT(YEAR FROM COALESCE(x, now())), trim(BOTH FROM q) FROM a", {"a"}),
    ("SELECT * FROM f(1), g, LATERAL h(g.x) i", {"g"}),
    ("SELECT 1 FROM (a JOIN b USING (id)) LEFT JOIN ONLY s.c ON 1 = (SELECT max(i) FROM m) FOR UPDATE", {"a", "b", "c", "m"}),
    ("SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u, v) GROUP BY x, y ORDER BY z, w", {"t", "u", "v"}),
    ("INSERT INTO t (a) VALUES (1) ON CONFLICT (a) DO UPDATE SET a = 2", {"t"}),
    ("", set()), ("CREATE TABLE x (a int)", set()), ("SELECT ((", set()), ("SELECT 1)) FROM t", {"t"}),
])
def test_tables_of_statements(spark, text, tables):
    rows = sql_lineage(spark.createDataFrame([("f", text)], "fqn string, text string")).collect()
    assert {r["table"] for r in rows} == tables


def test_a_target_may_be_read_too(spark):
    rows = sql_lineage(spark.createDataFrame([("f", "INSERT INTO t SELECT * FROM t JOIN u ON 1 = 1"), ("g", None)], "fqn string, text string")).collect()
    assert sorted((r["table"], r["access"]) for r in rows) == [("t", "READS"), ("t", "WRITES"), ("u", "READS")]


@pytest.mark.parametrize("method, fields", [
    ("findByAgeLessThanEqual", ["age"]), ("findByNotes", ["notes"]), ("findByOrderNumber", ["order_number"]), ("findByIndex", ["index"]),
    ("findByNameContainingIgnoreCaseOrAgeBetween", ["name", "age"]), ("deleteByEmailAndStatusNotIn", ["email", "status"]), ("findTop3ByActiveTrueOrderByNameDesc", ["active"]),
    ("countByLandmarkAndOriginIsNotNull", ["landmark", "origin"]), ("findByStartsAtGreaterThanAndAndroidIsFalse", ["starts_at", "android"]), ("findAll", []),
])
def test_fields_of_derived_queries(spark, method, fields):
    from graphlens.functions.text import derived_query_fields

    assert spark.createDataFrame([(method,)], "m string").select(derived_query_fields(F.col("m"))).first()[0] == fields


@pytest.mark.parametrize("decorator, queue", [
    ("@celery_app.task(bind=True, queue = 'mail')", "mail"), ('@shared_task(queue="a\'b")', "a'b"), ("worker.task", "celery"), ("@app . shared_task ( )", "celery"),
    ("@task", None), ("@app.tasks(queue='x')", None), ("@app.task(max_queue='x')", "celery"),
])
def test_task_decorators(spark, decorator, queue):
    from graphlens.operators.rules import messaging

    row = spark.createDataFrame([(decorator,)], "d string").select(F.col("d").rlike(messaging.TASK_DECORATOR), F.regexp_extract("d", messaging.QUEUE_ARGUMENT, 2)).first()
    assert (row[0] and (row[1] or messaging.DEFAULT_QUEUE)) == (queue or False)


@pytest.mark.parametrize("pattern, group, text, found", [
    (endpoints.ROUTE_DECORATOR, 3, "router.get('/a')", "/a"), (endpoints.ROUTE_DECORATOR, 3, '@app . post ( response_model=M, path = "/b", tags=["x"])', "/b"),
    (endpoints.ROUTER_PREFIX, 1, "APIRouter(tags=['t'], prefix='/')", "/"), (endpoints.ROUTER_PREFIX, 1, 'fastapi.APIRouter(dependencies=[Depends(f)], prefix = "/v1")', "/v1"),
    (endpoints.FLASK_ROUTE, 2, "@bp.route(rule='/x', methods=['GET'])", "/x"), (endpoints.FLASK_ROUTE, 2, 'bp.route ( "" )', ""),
    (endpoints.URL_RULE, 1, "app.add_url_rule('/u', view_func=f)", "/u"), (endpoints.URL_RULE, 1, 'add_url_rule(view_func=f, rule="/k")', "/k"),
    (endpoints.BLUEPRINT_PREFIX, 1, "Blueprint('n', __name__, url_prefix='/p')", "/p"), (endpoints.GIVEN_PREFIX, 1, 'register_blueprint(api.bp, url_prefix = "/q")', "/q"),
])
def test_route_strings(spark, pattern, group, text, found):
    row = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(pattern), endpoints._string("t", pattern, group)).first()
    assert tuple(row) == (True, found)


def test_include_rings_end(spark):
    includes = spark.createDataFrame([("root", "a", "x/"), ("a", "b", "y/"), ("b", "a", "z/")], "module string, included string, prefix string")
    assert {r["module"] for r in endpoints.include_prefixes(includes).collect()} == {"root", "a", "b"}


def test_projects_keep_their_own_nodes(make_graph):
    from graphlens.graph import Graph, node_rows
    from graphlens.operators.rules import RuleResult, merge_results

    graph = make_graph([{"fqn": "y", "kind": "CLASS", "app_name": "A"}, {"fqn": "y", "kind": "CLASS", "app_name": "B"}, {"fqn": "x", "kind": "CLASS", "app_name": "A"}], [])
    news = node_rows(graph.nodes.limit(0)).unionByName(node_rows(graph.nodes.filter("fqn = 'y'").limit(1).selectExpr("'y' AS fqn", "'TABLE' AS kind")))
    merged, _ = merge_results(Graph(graph.nodes, graph.edges), [RuleResult(nodes=news)])
    assert sorted(tuple(r) for r in merged.nodes.select("app_name", "fqn", "kind").collect()) == [("A", "x", "CLASS"), ("A", "y", "TABLE"), ("B", "y", "TABLE")]
