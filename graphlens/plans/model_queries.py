"""Entities, models, schema history, lineage and middleware over derived code."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.functions import text
from graphlens.functions.scale import numbered
from graphlens.operators.rules import mapping, middleware, schema_history
from graphlens.plans.registry import query, table
from graphlens.schema import literal_map
from graphlens.plans.rule_queries import build


def entity_graph(spark, d):
    """Customers as entities; the nation is the target of a foreign key."""
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    entities = customer.selectExpr(
        "concat('e.Cust', c_custkey) AS fqn", "concat('CustBox', c_custkey, 'y') AS name", "'CLASS' AS kind", "array('Entity') AS annotations",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN map('Table', concat('t_', c_custkey)) END AS annotation_args",
    )
    nations = nation.selectExpr("concat('e.Nat', n_nationkey) AS fqn", "concat('Nat', n_nationkey) AS name", "'CLASS' AS kind", "array('Entity') AS annotations")
    fields = [
        customer.selectExpr("concat('e.Cust', c_custkey, '.id') AS fqn", "'custKey' AS name", "'FIELD' AS kind", "'long' AS type", "array('Id') AS annotations"),
        customer.selectExpr("concat('e.Cust', c_custkey, '.nat') AS fqn", "'homeNation' AS name", "'FIELD' AS kind", "concat('Nat', c_nationkey) AS type", "array('ManyToOne', 'JoinColumn') AS annotations", "map('JoinColumn', 'nat_fk') AS annotation_args"),
        customer.selectExpr("concat('e.Cust', c_custkey, '.many') AS fqn", "'orders' AS name", "'FIELD' AS kind", "'List<Order>' AS type", "array('OneToMany') AS annotations"),
        customer.filter("c_acctbal > 9000").selectExpr("concat('e.Cust', c_custkey, '.tags') AS fqn", "'tags' AS name", "'FIELD' AS kind", "concat('Set<Nat', c_nationkey, '>') AS type", "array('ManyToMany', 'JoinTable') AS annotations", "map('JoinTable', concat('j', c_custkey)) AS annotation_args"),
        nation.selectExpr("concat('e.Nat', n_nationkey, '.id') AS fqn", "'id' AS name", "'FIELD' AS kind", "'int' AS type", "array('Id') AS annotations"),
    ]
    edges = [f.selectExpr("regexp_replace(fqn, '[.][a-z]+$', '') AS src", "fqn AS dst", "'CONTAINS' AS kind") for f in fields]
    return build([entities, nations, *fields], edges)


ENTITY = """e AS (SELECT c_custkey AS k, c_nationkey AS n, c_acctbal, 'table:' || CASE c_mktsegment WHEN 'BUILDING' THEN 't_' || c_custkey ELSE 'cust_box' || c_custkey || 'ies' END AS t FROM customer)"""


@query(
    "jn32_annotated_entities",
    f"""WITH {ENTITY} SELECT 'e.Cust' || k AS src, t AS dst, 'MAPS_TO' AS kind FROM e UNION ALL SELECT t, t || '.' || c, 'HAS_COLUMN' FROM e, (SELECT unnest(['cust_key', 'nat_fk']) AS c)
    UNION ALL SELECT t, t || '.tags', 'HAS_COLUMN' FROM e WHERE c_acctbal > 9000 UNION ALL SELECT t || '.nat_fk', 'table:nat' || n || 's.id', 'REFERENCES' FROM e
    UNION ALL SELECT 'e.Nat' || n_nationkey, 'table:nat' || n_nationkey || 's', 'MAPS_TO' FROM nation UNION ALL SELECT 'table:nat' || n_nationkey || 's', 'table:nat' || n_nationkey || 's.id', 'HAS_COLUMN' FROM nation
    UNION ALL SELECT 'table:j' || k, 'table:j' || k || '.cust_box' || k || 'y_id', 'HAS_COLUMN' FROM e WHERE c_acctbal > 9000 UNION ALL SELECT 'table:j' || k || '.cust_box' || k || 'y_id', t || '.cust_key', 'REFERENCES' FROM e WHERE c_acctbal > 9000
    UNION ALL SELECT 'table:j' || k, 'table:j' || k || '.nat' || n || '_id', 'HAS_COLUMN' FROM e WHERE c_acctbal > 9000 UNION ALL SELECT 'table:j' || k || '.nat' || n || '_id', 'table:nat' || n || 's.id', 'REFERENCES' FROM e WHERE c_acctbal > 9000""",
)
def _(spark, d):
    return mapping.annotated_entities(entity_graph(spark, d)).edges.select("src", "dst", "kind")


def declared_graph(spark, d):
    part = table(spark, d, "part")
    classes = part.selectExpr("concat('shop.models.P', p_partkey) AS fqn", "concat('PartBox', p_partkey) AS name", "'CLASS' AS kind", "'python' AS language")
    flavour = "CASE p_type WHEN 'PROMO' THEN 'django' WHEN 'SMALL' THEN 'flask' ELSE 'plain' END"
    inherits = part.selectExpr("concat('shop.models.P', p_partkey) AS src", f"CASE {flavour} WHEN 'django' THEN 'django.db.models.Model' WHEN 'flask' THEN 'db.Model' ELSE 'Base' END AS dst", "'INHERITS' AS kind")
    fields = [
        part.filter("p_type <> 'PROMO' AND (p_type <> 'SMALL' OR p_size > 25)").selectExpr("concat('shop.models.P', p_partkey, '.__tablename__') AS fqn", "'__tablename__' AS name", "'FIELD' AS kind", "concat('\"tab', p_partkey, '\"') AS value"),
        part.selectExpr(
            "concat('shop.models.P', p_partkey, '.key') AS fqn", "'key' AS name", "'FIELD' AS kind",
            f"CASE {flavour} WHEN 'django' THEN 'models.IntegerField()' WHEN 'flask' THEN 'db.Column(db.Integer, primary_key=True)' ELSE 'mapped_column(String(20), primary_key=True)' END AS value",
        ),
        part.selectExpr(
            "concat('shop.models.P', p_partkey, '.ref') AS fqn", "'ref' AS name", "'FIELD' AS kind",
            f"CASE {flavour} WHEN 'django' THEN concat('models.ForeignKey(\"PartBox', p_partkey, '\", on_delete=x)') WHEN 'flask' THEN 'db.Column(db.ForeignKey(\"t.c\"))' ELSE 'Column(ForeignKey(\"u.v\"))' END AS value",
        ),
    ]
    contains = [f.selectExpr("regexp_replace(fqn, '[.]\\\\w+$', '') AS src", "fqn AS dst", "'CONTAINS' AS kind") for f in fields]
    return build([classes, *fields], [inherits, *contains])


DECLARED = """p AS (SELECT p_partkey AS k, p_type, p_size, 'table:' || CASE p_type WHEN 'PROMO' THEN 'shop_partbox' || p_partkey WHEN 'SMALL' THEN CASE WHEN p_size > 25 THEN 'tab' || p_partkey ELSE 'part_box' || p_partkey END
    ELSE 'tab' || p_partkey END AS t FROM part)"""


def _declared_sql(where, django=False):
    extra = "UNION ALL SELECT t, t || '.id', 'HAS_COLUMN' FROM q" if django else ""
    ref = "t || '.id'" if django else ("'table:t.c'" if "= 'SMALL'" in where else "'table:u.v'")
    col = "ref_id" if django else "ref"
    return f"""WITH {DECLARED}, q AS (SELECT * FROM p WHERE {where}) SELECT 'shop.models.P' || k AS src, t AS dst, 'MAPS_TO' AS kind FROM q
    UNION ALL SELECT t, t || '.key', 'HAS_COLUMN' FROM q UNION ALL SELECT t, t || '.{col}', 'HAS_COLUMN' FROM q {extra} UNION ALL SELECT t || '.{col}', {ref}, 'REFERENCES' FROM q"""


@query("jn32_declared_tables", _declared_sql("p_type NOT IN ('PROMO', 'SMALL')"))
def _(spark, d):
    return mapping.declared_columns(declared_graph(spark, d), "table_name").edges.select("src", "dst", "kind")


@query("jn32_heir_tables", _declared_sql("p_type = 'SMALL'"))
def _(spark, d):
    return mapping.declared_columns(declared_graph(spark, d), "flask").edges.select("src", "dst", "kind")


@query("jn32_model_tables", _declared_sql("p_type = 'PROMO'", django=True))
def _(spark, d):
    return mapping.declared_columns(declared_graph(spark, d), "django").edges.select("src", "dst", "kind")


@query("jn32_context_sets", "SELECT 'db.X' || n_nationkey AS context, 'db.E' || c_custkey AS entity FROM nation JOIN customer ON c_nationkey = n_nationkey")
def _(spark, d):
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    contexts = nation.selectExpr("concat('db.X', n_nationkey) AS fqn", "concat('X', n_nationkey) AS name", "'CLASS' AS kind", "CASE WHEN n_nationkey < 5 THEN 'DbContext' ELSE concat('X', n_nationkey - 5) END AS base_class")
    entities = customer.selectExpr("concat('db.E', c_custkey) AS fqn", "concat('E', c_custkey) AS name", "'CLASS' AS kind")
    sets = customer.selectExpr("concat('db.X', c_nationkey, '.s', c_custkey) AS fqn", "'s' AS name", "'FIELD' AS kind", "concat('DbSet<E', c_custkey, '>') AS type")
    held = customer.selectExpr("concat('db.X', c_nationkey) AS src", "concat('db.X', c_nationkey, '.s', c_custkey) AS dst", "'CONTAINS' AS kind")
    return mapping.context_entities(build([contexts, entities, sets], [held]))


METHOD = "CASE c_nationkey % 4 WHEN 0 THEN 'findByName' WHEN 1 THEN 'deleteByEmailAndStatus' WHEN 2 THEN 'save' ELSE 'helper' END"


def repository_graph(spark, d):
    customer = table(spark, d, "customer")
    repos = customer.selectExpr("concat('r.R', c_custkey) AS fqn", "concat('R', c_custkey) AS name", "'INTERFACE' AS kind")
    entities = customer.selectExpr("concat('e.E', c_custkey) AS fqn", "concat('E', c_custkey) AS name", "'CLASS' AS kind", "array('Entity') AS annotations")
    methods = customer.selectExpr(f"concat('r.R', c_custkey, '.', {METHOD}) AS fqn", f"{METHOD} AS name", "'FUNCTION' AS kind")
    edges = [
        customer.selectExpr("concat('r.R', c_custkey) AS src", "'org.x.JpaRepository' AS dst", "'INHERITS' AS kind"),
        customer.selectExpr("concat('r.R', c_custkey) AS src", f"concat('r.R', c_custkey, '.', {METHOD}) AS dst", "'CONTAINS' AS kind"),
        customer.filter("c_acctbal > 0").selectExpr("concat('e.E', c_custkey) AS src", "concat('table:e', c_custkey) AS dst", "'MAPS_TO' AS kind"),
    ]
    return build([repos, entities, methods], edges), customer.selectExpr("concat('r.R', c_custkey) AS repository", "concat('E', c_custkey) AS entity_name")


@query(
    "jn31_repositories",
    f"""WITH c AS (SELECT c_custkey AS k, c_acctbal > 0 AS mapped, {METHOD} AS m FROM customer), s AS (SELECT unnest(['save', 'saveAll', 'deleteById', 'delete', 'deleteAll', 'findById', 'findAll', 'findAllById', 'count', 'existsById']) AS name),
    w AS (SELECT name, name IN ('save', 'saveAll', 'deleteById', 'delete', 'deleteAll') AS writes FROM s)
    SELECT 'r.R' || k AS src, 'e.E' || k AS dst, 'MANAGES' AS kind FROM c UNION ALL SELECT 'r.R' || k, 'r.R' || k || '.' || name, 'CONTAINS' FROM c, w WHERE name <> m
    UNION ALL SELECT 'r.R' || k || '.' || name, 'table:e' || k, CASE WHEN writes THEN 'WRITES' ELSE 'READS' END FROM c, w WHERE mapped
    UNION ALL SELECT 'r.R' || k || '.' || m, 'table:e' || k, CASE m WHEN 'findByName' THEN 'READS' ELSE 'WRITES' END FROM c WHERE mapped AND m IN ('findByName', 'deleteByEmailAndStatus')""",
)
def _(spark, d):
    return mapping.repositories(*repository_graph(spark, d)).edges.select("src", "dst", "kind")


@query(
    "jn31_query_annotations",
    """SELECT 'r.R' || c_custkey || '.q' AS src, CASE WHEN c_mktsegment <> 'FURNITURE' AND c_acctbal <= 0 THEN 'table:E' ELSE 'table:e' END || c_custkey AS dst,
      CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'READS' ELSE 'WRITES' END AS kind
    FROM customer WHERE c_acctbal > 0 OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""",
)
def _(spark, d):
    graph, names = repository_graph(spark, d)
    text = """CASE c_mktsegment WHEN 'BUILDING' THEN concat('select x from E', c_custkey, ' x join x.others o where o.a = :a') WHEN 'FURNITURE' THEN concat('UPDATE e', c_custkey, ' SET a = 1, b = 2')
      WHEN 'MACHINERY' THEN concat('from E', c_custkey) ELSE concat('DELETE FROM E', c_custkey, ' x WHERE x.a = 1') END"""
    customer = table(spark, d, "customer")
    methods = customer.selectExpr("concat('r.R', c_custkey, '.q') AS fqn", "'q' AS name", "'FUNCTION' AS kind", "array('Query') AS annotations", f"map('Query', {text}) AS annotation_args")
    held = customer.selectExpr("concat('r.R', c_custkey) AS src", "concat('r.R', c_custkey, '.q') AS dst", "'CONTAINS' AS kind")
    edges = mapping.repositories(graph.plus(methods, held), names).edges
    return edges.filter("src LIKE '%.q' AND kind IN ('READS', 'WRITES')").select("src", "dst", "kind")


@query(
    "fn_derived_query_name",
    f"SELECT c_custkey, {METHOD} AS method, CASE {METHOD} WHEN 'findByName' THEN 'read' WHEN 'deleteByEmailAndStatus' THEN 'write' ELSE 'unknown' END AS access, CASE {METHOD} WHEN 'findByName' THEN 'name' WHEN 'deleteByEmailAndStatus' THEN 'email,status' ELSE '' END AS fields FROM customer",
)
def _(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey", f"{METHOD} AS method")
    return rows.select("c_custkey", "method", text.derived_query_access(F.col("method")).alias("access"), F.array_join(text.derived_query_fields(F.col("method")), ",").alias("fields"))


def model_graph(spark, d):
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    models = nation.selectExpr("concat('api.m', n_nationkey, '.Model', n_nationkey) AS fqn", "concat('Model', n_nationkey) AS name", "'CLASS' AS kind")
    fields = customer.selectExpr(
        "concat('api.m', c_nationkey, '.Model', c_nationkey, '.f', c_custkey) AS fqn", "concat('f', c_custkey % 40) AS name", "'FIELD' AS kind",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'str | None' WHEN 'FURNITURE' THEN 'int' WHEN 'MACHINERY' THEN 'float' ELSE 'dict' END AS type", "concat('Field(min_length=', c_nationkey, ', title=\"x\", default=\"d\")') AS value",
    )
    validators = nation.selectExpr("concat('api.m', n_nationkey, '.Model', n_nationkey, '.check') AS fqn", "'check' AS name", "'FUNCTION' AS kind", "array('other', concat('field_validator(\"f', n_nationkey, '\")')) AS annotations")
    columns = table(spark, d, "part").selectExpr("concat('table:p', p_partkey, '.f') AS fqn", "concat('f', p_partkey % 300) AS name", "'COLUMN' AS kind", "CASE WHEN p_size > 25 THEN 'varchar(20)' WHEN p_size > 12 THEN 'BIGINT' ELSE 'BLOB' END AS type")
    handlers = customer.selectExpr(
        "concat('api.m', c_nationkey, '.h', c_custkey) AS fqn", "'h' AS name", "'FUNCTION' AS kind",
        "array(named_struct('name', 'b', 'type', CASE c_mktsegment WHEN 'BUILDING' THEN concat('list[Model', c_nationkey, ']') WHEN 'FURNITURE' THEN 'Model0 | None' ELSE 'int' END, 'annotations', array(''), 'qualifier', '')) AS params",
        "CASE WHEN c_acctbal > 0 THEN concat('api.m', c_nationkey, '.Model', c_nationkey) END AS return_type",
    )
    points = customer.selectExpr("concat('ep:', c_custkey) AS fqn", "'API_ENDPOINT' AS kind")
    edges = [
        nation.selectExpr("concat('api.m', n_nationkey, '.Model', n_nationkey) AS src", "CASE WHEN n_regionkey = 0 THEN 'app.base.BaseModel' ELSE 'pydantic.v1.BaseModel' END AS dst", "'INHERITS' AS kind"),
        customer.selectExpr("concat('api.m', c_nationkey, '.Model', c_nationkey) AS src", "concat('api.m', c_nationkey, '.Model', c_nationkey, '.f', c_custkey) AS dst", "'CONTAINS' AS kind"),
        nation.selectExpr("concat('api.m', n_nationkey, '.Model', n_nationkey) AS src", "concat('api.m', n_nationkey, '.Model', n_nationkey, '.check') AS dst", "'CONTAINS' AS kind"),
        customer.selectExpr("concat('api.m', c_nationkey, '.h', c_custkey) AS src", "concat('ep:', c_custkey) AS dst", "'HANDLES' AS kind"),
    ]
    return build([models, fields, validators, columns, handlers, points], edges)


@query(
    "jn27_model_links",
    """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_acctbal, CASE c_mktsegment WHEN 'BUILDING' THEN c_nationkey WHEN 'FURNITURE' THEN 0 END AS asked FROM customer)
    SELECT 'ep:' || k AS src, 'api.m' || asked || '.Model' || asked AS dst, 'ACCEPTS' AS kind FROM c JOIN nation ON n_nationkey = asked WHERE n_regionkey <> 0
    UNION ALL SELECT 'ep:' || k, 'api.m' || n || '.Model' || n, 'RETURNS' FROM c JOIN nation ON n_nationkey = n WHERE n_regionkey <> 0 AND c_acctbal > 0""",
)
def _(spark, d):
    return mapping.model_links(model_graph(spark, d)).select("src", "dst", "kind")


@query(
    "jn28_field_columns",
    """WITH f AS (SELECT 'api.m' || c_nationkey || '.Model' || c_nationkey || '.f' || c_custkey AS src, 'f' || (c_custkey % 40) AS name, c_mktsegment AS s FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 0),
    p AS (SELECT f.src, 'table:p' || p_partkey || '.f' AS dst FROM f JOIN part ON 'f' || (p_partkey % 300) = name AND ((s = 'BUILDING' AND p_size > 25) OR (s = 'FURNITURE' AND p_size > 12 AND p_size <= 25)))
    SELECT src, dst, CASE WHEN count(*) OVER (PARTITION BY src) = 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM p""",
)
def _(spark, d):
    from graphlens.schema import confidence_name

    return mapping.field_columns(model_graph(spark, d)).select("src", "dst", confidence_name(F.col("confidence")).alias("confidence"))


@query("jn47_model_constraints", "SELECT 'api.m' || c_nationkey || '.Model' || c_nationkey || '.f' || c_custkey AS fqn, 'default=d,min_length=' || c_nationkey AS constraints FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 0")
def _(spark, d):
    rows = mapping.model_constraints(model_graph(spark, d))
    return rows.select("fqn", F.array_join(F.transform(F.array_sort(F.map_entries("constraints")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("constraints"))


@query("jn47_model_validators", "SELECT 'api.m' || n_nationkey || '.Model' || n_nationkey || '.check' AS fqn, 'field_validator' AS validator_kind, 'f' || n_nationkey AS target_field FROM nation WHERE n_regionkey <> 0")
def _(spark, d):
    return mapping.model_validators(model_graph(spark, d))


@query(
    "jn44_settings",
    """SELECT 'config:site.s' || c_custkey || '.' || k AS fqn, CASE k WHEN 'INSTALLED_APPS' THEN 'items=a' || c_nationkey || ',b' WHEN 'DATABASES' THEN 'default_engine=pg,default_name=n' || c_nationkey ELSE 'text=auth.User' END AS value
    FROM customer, (SELECT unnest(['INSTALLED_APPS', 'DATABASES', 'AUTH_USER_MODEL']) AS k) WHERE c_mktsegment <> 'BUILDING'""",
)
def _(spark, d):
    customer = table(spark, d, "customer")
    modules = customer.selectExpr("concat('site.s', c_custkey) AS fqn", "'MODULE' AS kind")
    rows = customer.selectExpr(
        "c_custkey", "explode(map('INSTALLED_APPS', concat('[\"a', c_nationkey, '\", \\'b\\']'), 'DATABASES', concat('{\"default\": {\"ENGINE\": \"pg\", \"NAME\": \"n', c_nationkey, '\", \"PORT\": 5}}'), "
        "'AUTH_USER_MODEL', '\"auth.User\"', 'OTHER', '1')) AS (name, value)", "c_mktsegment",
    ).filter("name <> 'INSTALLED_APPS' OR c_mktsegment <> 'BUILDING'")
    fields = rows.selectExpr("concat('site.s', c_custkey, '.', name) AS fqn", "name", "'FIELD' AS kind", "value")
    held = rows.selectExpr("concat('site.s', c_custkey) AS src", "concat('site.s', c_custkey, '.', name) AS dst", "'CONTAINS' AS kind")
    entries = mapping.settings(build([modules, fields], [held])).nodes.filter("kind = 'CONFIG_ENTRY'")
    return entries.select("fqn", F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("value"))


# --- schema history ------------------------------------------------------------------------------


def migrations(spark, d):
    create = "concat('CREATE TABLE t', s_nationkey, ' (id INT PRIMARY KEY, c', s_suppkey, ' DECIMAL(10,2) NOT NULL, FOREIGN KEY (c', s_suppkey, ') REFERENCES t0 (id)); CREATE INDEX i', s_suppkey, ' ON t', s_nationkey, ' (id, c', s_suppkey, ');')"
    alter = "concat('-- note; x\\nALTER TABLE t', s_nationkey, ' ADD COLUMN d', s_suppkey % 5, ' varchar(', s_suppkey, ');')"
    return table(spark, d, "supplier").selectExpr("concat('V', s_suppkey, '.', s_nationkey, '__m.sql') AS name", f"CASE WHEN s_acctbal > 6000 THEN {create} ELSE {alter} END AS text")


HISTORY = """s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_acctbal > 6000 AS makes FROM supplier), born AS (SELECT n, max(k) AS b FROM s WHERE makes GROUP BY 1),
  ev AS (SELECT n, k, unnest(CASE WHEN makes THEN [{'c': 'id', 't': 'INT'}, {'c': 'c' || k, 't': 'DECIMAL(10,2)'}] ELSE [{'c': 'd' || (k % 5), 't': 'VARCHAR(' || k || ')'}] END) AS x FROM s),
  live AS (SELECT ev.n, x.c AS c, max_by(x.t, k) AS t FROM ev LEFT JOIN born ON born.n = ev.n WHERE b IS NULL OR k >= b GROUP BY 1, 2)"""


@query("win10_schema_history", f"""WITH {HISTORY} SELECT 't' || n AS "table", c AS "column", t AS type FROM live""")
def _(spark, d):
    columns, _references, _indexes = schema_history.fold_schema(schema_history.statements(migrations(spark, d)))
    return columns.select("table", "column", "type")


@query("win10_schema_indexes", """SELECT 'i' || s_suppkey AS "index", 't' || s_nationkey AS "table", unnest(['id', 'c' || s_suppkey]) AS "column" FROM supplier WHERE s_acctbal > 6000""")
def _(spark, d):
    return schema_history.fold_schema(schema_history.statements(migrations(spark, d)))[2].drop("is_unique")


@query(
    "win11_schema_graph",
    f"""WITH {HISTORY} SELECT 'table:t' || n AS src, 'table:t' || n || '.' || c AS dst, 'HAS_COLUMN' AS kind FROM live UNION ALL SELECT 'table:t' || n || '.c' || k, 'table:t0.id', 'REFERENCES' FROM s WHERE makes""",
)
def _(spark, d):
    columns, references, _indexes = schema_history.fold_schema(schema_history.statements(migrations(spark, d)))
    return schema_history.schema_graph(columns, references).edges.select("src", "dst", "kind")


@query(
    "jn42_revision_chain",
    "SELECT 'alembic:r' || a.o_orderkey AS src, 'alembic:r' || a.o_custkey AS dst FROM orders a WHERE a.o_orderstatus <> 'P' AND EXISTS (SELECT 1 FROM orders b WHERE b.o_orderkey = a.o_custkey)",
)
def _(spark, d):
    revisions = table(spark, d, "orders").selectExpr("concat('r', o_orderkey) AS revision", "CASE WHEN o_orderstatus <> 'P' THEN concat('r', o_custkey) END AS down_revision")
    return schema_history.revision_chain(revisions).edges.select("src", "dst")


SQL_TEXT = """CASE l_returnflag WHEN 'R' THEN 'select a from t' || l_suppkey || ' x join u' || l_linenumber || ' on 1=1 where n = ''from zz''' WHEN 'A' THEN 'INSERT INTO w' || l_suppkey || ' SELECT * FROM r' || l_linenumber
  ELSE CASE l_linestatus WHEN 'O' THEN 'WITH q AS (SELECT 1 FROM s' || l_suppkey || ') SELECT * FROM q JOIN v' || l_linenumber || ' ON 1=1' WHEN 'F' THEN 'UPDATE y' || l_suppkey || ' SET a = 1' END END"""


@query(
    "jn43_sql_lineage",
    """SELECT 'f' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS fqn, tab AS "table", access FROM (SELECT l_orderkey, l_linenumber, l_partkey,
      unnest(CASE l_returnflag WHEN 'R' THEN [{'t': 't' || l_suppkey, 'a': 'READS'}, {'t': 'u' || l_linenumber, 'a': 'READS'}] WHEN 'A' THEN [{'t': 'w' || l_suppkey, 'a': 'WRITES'}, {'t': 'r' || l_linenumber, 'a': 'READS'}]
        ELSE CASE l_linestatus WHEN 'O' THEN [{'t': 's' || l_suppkey, 'a': 'READS'}, {'t': 'v' || l_linenumber, 'a': 'READS'}] ELSE [{'t': 'y' || l_suppkey, 'a': 'WRITES'}] END END, recursive := true) FROM lineitem) x(o, l, p, tab, access)""".replace(
        "'f' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS fqn", "'f' || o || '_' || l || '_' || p AS fqn"
    ),
)
def _(spark, d):
    texts = table(spark, d, "lineitem").selectExpr("concat('f', l_orderkey, '_', l_linenumber, '_', l_partkey) AS fqn", SQL_TEXT.replace("''from zz''", "\\'from zz\\'") + " AS text")
    return schema_history.sql_lineage(texts).drop("query_type")


# --- middleware ------------------------------------------------------------------------------------


CALL = "CASE l_linenumber WHEN 1 THEN 'UseAuthorization' WHEN 2 THEN 'UseAuthentication' WHEN 3 THEN 'UseCors' WHEN 4 THEN 'UseMiddleware<M' || (l_partkey % 10) || '>' ELSE 'UseStaticFiles' END"


def middleware_calls(spark, d):
    """The lines of an order are the middleware calls of one class, by part number."""
    rows = table(spark, d, "lineitem").selectExpr("concat('o', l_orderkey) AS cls", f"{CALL} AS name", "l_partkey", "l_suppkey", "l_linenumber").distinct()
    return numbered(rows, ["cls"], ["l_partkey", "l_suppkey", "l_linenumber"], "pos").select("cls", "pos", "name")


CALLS = f"""calls AS (SELECT 'o' || l_orderkey AS cls, name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) - 1 AS pos
  FROM (SELECT DISTINCT l_orderkey, {CALL} AS name, l_partkey, l_suppkey, l_linenumber FROM lineitem))"""


@query(
    "win5_middleware_chain",
    f"""WITH {CALLS} SELECT cls || '::middleware::' || name AS src, cls || '::middleware::' || nxt AS dst, CAST(pos AS VARCHAR) AS "order" FROM (SELECT *, lead(name) OVER (PARTITION BY cls ORDER BY pos) AS nxt FROM calls) WHERE nxt IS NOT NULL""",
)
def _(spark, d):
    return middleware.chain(middleware_calls(spark, d)).select("src", "dst", F.col("props")["order"].alias("order"))


@query(
    "win6_ordering_violations",
    f"""WITH {CALLS}, p AS (SELECT cls, max(pos) FILTER (name = 'UseAuthentication') AS a, max(pos) FILTER (name = 'UseAuthorization') AS z, max(pos) FILTER (name = 'UseCors') AS c FROM calls GROUP BY 1)
    SELECT cls, 'authorization before authentication' AS issue FROM p WHERE z < a UNION ALL SELECT cls, 'cors after authentication' FROM p WHERE c > a""",
)
def _(spark, d):
    return middleware.ordering_violations(middleware_calls(spark, d))


@query(
    "jn45_middleware_handlers",
    f"""WITH {CALLS} SELECT DISTINCT 'mw.M' || substr(name, 16, 1) AS src, cls || '::middleware::' || name AS dst FROM calls WHERE name LIKE 'UseMiddleware%' AND substr(name, 16, 1)::INT < 5""",
)
def _(spark, d):
    part = table(spark, d, "part")
    classes = part.selectExpr("concat('mw.M', p_partkey % 10) AS fqn", "concat('M', p_partkey % 10) AS name", "'CLASS' AS kind").distinct()
    methods = classes.selectExpr("concat(fqn, '.', CASE WHEN fqn < 'mw.M5' THEN 'InvokeAsync' ELSE 'Run' END) AS fqn", "CASE WHEN fqn < 'mw.M5' THEN 'InvokeAsync' ELSE 'Run' END AS name", "'FUNCTION' AS kind")
    held = methods.selectExpr("substring_index(fqn, '.', 2) AS src", "fqn AS dst", "'CONTAINS' AS kind")
    result = middleware.middleware(build([classes, methods], [held]), middleware_calls(spark, d))
    return result.edges.filter("kind = 'HANDLES'").select("src", "dst").distinct()


#: Statements with scopes, quotes, functions and local names, by market segment; ``#`` stands for the customer's key.
SCOPED = {
    "AUTOMOBILE": ("WITH RECURSIVE c(n) AS (SELECT 1 FROM s# UNION ALL SELECT n FROM c) SELECT * FROM c JOIN d# ON 1 = 1, e#", [("s#", "READS"), ("d#", "READS"), ("e#", "READS")]),
    "BUILDING": ('SELECT EXTRACT(YEAR FROM COALESCE(x, now())) FROM "My Table #" t, (SELECT 1 FROM z#) x, f(1), g# WHERE x IS DISTINCT FROM y', [("My Table #", "READS"), ("z#", "READS"), ("g#", "READS")]),
    "FURNITURE": ("INSERT INTO t# (a, b) SELECT a, b FROM t# x, (u# JOIN v# USING (id)) FOR UPDATE", [("t#", "READS"), ("u#", "READS"), ("v#", "READS"), ("t#", "WRITES")]),
    "HOUSEHOLD": ("DELETE FROM t# USING u# WHERE i IN (SELECT i FROM v#)", [("t#", "WRITES")]),
    "MACHINERY": ("UPDATE a.t# SET x = (SELECT max(y) FROM m#) WHERE z IN (SELECT z FROM n#)", [("t#", "WRITES")]),
}


@query(
    "jn43_scoped_statements",
    " UNION ALL ".join(
        f"""SELECT c_custkey AS fqn, replace('{name}', '#', c_custkey::VARCHAR) AS "table", '{access}' AS access FROM customer WHERE c_mktsegment = '{segment}'"""
        for segment, (_, found) in SCOPED.items() for name, access in found
    ),
)
def _(spark, d):
    text = literal_map({segment: statement for segment, (statement, _) in SCOPED.items()})[F.col("c_mktsegment")]
    texts = table(spark, d, "customer").select(F.col("c_custkey").alias("fqn"), F.replace(text, F.lit("#"), F.col("c_custkey").cast("string")).alias("text"))
    return schema_history.sql_lineage(texts).drop("query_type")
