"""Inventory, symbol index, code view and sinks over documents and parts as source files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphlens.functions import text
from graphlens.functions.scale import shared_dir
from graphlens.graph import Graph, edge_rows, merge, node_rows
from graphlens.plans.derived import SHOP, SHOP_EDGES, SHOP_NODES, shop_graph
from graphlens.plans.registry import query, table
from graphlens.sources import inventory, sinks, symbols

PATH = """CASE source WHEN 'src0' THEN 'node_modules' WHEN 'src1' THEN '.hidden' ELSE source END || '/' ||
  CASE lang WHEN 'en' THEN 'A' || doc_id || '.java' WHEN 'fr' THEN 'b' || doc_id || '.PY' WHEN 'de' THEN 'c.d' || doc_id || '.tsx' ELSE 'e' || doc_id || '.md' END"""
LANG = "CASE lang WHEN 'en' THEN 'java' WHEN 'fr' THEN 'python' WHEN 'de' THEN 'typescript' END"


def document_files(spark, d):
    """Documents as files; the text gets comment lines so that counting has work to do."""
    body = "concat('// head\\n', replace(text, '. ', '.\\n # '), '\\n\\n  * tail\\n-- end')"
    return table(spark, d, "documents").selectExpr("source AS app_name", f"{PATH} AS path", f"{body} AS text", "doc_id")


FILES = f"""files AS (SELECT doc_id, source AS app_name, {PATH} AS path, {LANG} AS language,
  '// head' || chr(10) || replace(text, '. ', '.' || chr(10) || ' # ') || chr(10) || chr(10) || '  * tail' || chr(10) || '-- end' AS text FROM documents)"""
LOC = "len(list_filter(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x{85}\\x{2028}\\x{2029}]'), lambda l: regexp_matches(l, '\\S') AND NOT regexp_matches(l, '^\\s*(//|#|/\\*|\\*|--)')))"


@query("src1_source_scan", f"WITH {FILES} SELECT app_name, path, language FROM files WHERE app_name NOT IN ('src0', 'src1') AND language IS NOT NULL")
def _(spark, d):
    return inventory.source_files(document_files(spark, d)).select("app_name", "path", "language")


@query("src2_language", f"WITH {FILES} SELECT doc_id, language FROM files")
def _(spark, d):
    return document_files(spark, d).select("doc_id", inventory.language_of(F.col("path")).alias("language"))


@query("src3_lines_of_code", f"WITH {FILES} SELECT doc_id, CAST({LOC} AS INTEGER) AS loc FROM files")
def _(spark, d):
    return inventory.with_loc(document_files(spark, d)).select("doc_id", "loc")


@query("src4_language_rollup", f"WITH {FILES} SELECT language, count(*) AS file_count, CAST(sum({LOC}) AS BIGINT) AS total_loc FROM files WHERE app_name NOT IN ('src0', 'src1') AND language IS NOT NULL GROUP BY 1")
def _(spark, d):
    return inventory.language_rollup(inventory.with_loc(inventory.source_files(document_files(spark, d)))).orderBy(F.desc("file_count"))


CONFIG = """CASE p_size % 10 WHEN 0 THEN 'pom.xml' WHEN 1 THEN 'build.gradle' WHEN 2 THEN 'build.gradle.kts' WHEN 3 THEN 'package.json' WHEN 4 THEN 'pyproject.toml'
  WHEN 5 THEN 'setup.py' WHEN 6 THEN 'requirements.txt' WHEN 7 THEN p_type || '.csproj' WHEN 8 THEN p_type || '.sln' ELSE 'notes.txt' END"""
FOLDER = "CASE p_type WHEN 'PROMO' THEN '' WHEN 'LARGE' THEN 'vendor/' WHEN 'SMALL' THEN 'a/b/' ELSE lower(p_type) || '/' END"
LF = "char(10)"


def config_text(lf):
    return f"""CASE p_size % 10 WHEN 0 THEN '<project><dependency><groupId>org.' || p_type || '</groupId><artifactId>spring-boot</artifactId><version>' || p_size || '</version></dependency>'
      || '<!-- <dependency><groupId>x</groupId><artifactId>y</artifactId></dependency> --><dependency><groupId>g</groupId><artifactId>' || p_brand || '</artifactId><scope>test</scope></dependency></project>'
    WHEN 1 THEN 'implementation "org.' || p_type || ':hibernate-core:' || p_size || '"' || {lf} || 'testImplementation(''junit:junit:4'')' || {lf}
    WHEN 2 THEN 'runtimeOnly("org.spring:spring-data-jpa")' || {lf}
    WHEN 3 THEN '{{"dependencies": {{"express": "^' || p_size || '", "' || lower(p_brand) || '": "1"}}, "devDependencies": {{"react": "18"}}}}'
    WHEN 4 THEN '[build]' || {lf} || 'x = 1' || {lf} || '[project]' || {lf} || 'name = "n"' || {lf} || 'dependencies = ["Django>=' || p_size || '", "uvicorn[standard]==0.24"]' || {lf} || '[tool]' || {lf}
    WHEN 5 THEN 'install_requires fastapi'
    WHEN 6 THEN '# note' || {lf} || 'flask==' || p_size || {lf} || '-r other.txt' || {lf} || 'fastapi' || {lf}
    WHEN 7 THEN '<Project Sdk="Microsoft.NET.Sdk.Web"><PackageReference Include="EntityFramework" Version="' || p_size || '" /><PackageReference Include="' || p_brand || '"><Version>2</Version></PackageReference></Project>'
    ELSE 'EntityFramework django' END"""


def config_files(spark, d):
    return table(spark, d, "part").selectExpr("concat('app', p_brand) AS app_name", f"{FOLDER} || {CONFIG} AS path", f"{config_text(LF)} AS text").distinct()


CONFIG_FILES = f"""cfg AS (SELECT DISTINCT 'app' || p_brand AS app_name, {FOLDER} || {CONFIG} AS path, {FOLDER} AS folder, {CONFIG} AS file, {config_text('chr(10)')} AS text, p_type, p_brand, p_size FROM part)"""


@query(
    "src5_build_tools",
    f"""WITH {CONFIG_FILES}, c AS (SELECT DISTINCT app_name, CASE folder WHEN '' THEN '.' ELSE rtrim(folder, '/') END AS subproject_root, file,
      CASE WHEN file = 'pom.xml' THEN 'maven' WHEN file LIKE 'build.gradle%' THEN 'gradle' WHEN file = 'package.json' THEN 'npm'
        WHEN file LIKE '%.csproj' OR file LIKE '%.sln' THEN 'dotnet' ELSE 'python' END AS family,
      CASE WHEN file IN ('build.gradle.kts', 'setup.py') OR file LIKE '%.sln' THEN 2 WHEN file = 'requirements.txt' THEN 3 ELSE 1 END AS prio
      FROM cfg WHERE folder NOT IN ('vendor/', 'a/b/') AND file <> 'notes.txt')
    SELECT app_name, subproject_root, CASE family WHEN 'python' THEN CASE WHEN file = 'pyproject.toml' THEN 'uv/pip' ELSE 'pip' END ELSE family END AS tool,
      CASE family WHEN 'maven' THEN 'java' WHEN 'gradle' THEN 'java' WHEN 'npm' THEN 'javascript' WHEN 'python' THEN 'python' ELSE 'csharp' END AS language, file AS config_file
    FROM (SELECT *, row_number() OVER (PARTITION BY app_name, subproject_root, family ORDER BY prio, file) AS r FROM c) WHERE r = 1""",
)
def _(spark, d):
    return inventory.build_tools(config_files(spark, d))


@query(
    "src6_frameworks",
    f"""WITH {CONFIG_FILES} SELECT DISTINCT app_name, f AS framework, CASE f WHEN 'express' THEN 'javascript' WHEN 'react' THEN 'javascript' WHEN 'django' THEN 'python'
      WHEN 'fastapi' THEN 'python' WHEN 'aspnet' THEN 'csharp' WHEN 'efcore' THEN 'csharp' ELSE 'java' END AS language
    FROM (SELECT app_name, unnest(CASE p_size % 10 WHEN 0 THEN ['spring-boot'] WHEN 1 THEN ['hibernate'] WHEN 2 THEN ['spring-data-jpa'] WHEN 3 THEN ['express', 'react']
      WHEN 4 THEN ['django'] WHEN 5 THEN ['fastapi'] WHEN 6 THEN ['fastapi'] WHEN 7 THEN ['aspnet', 'efcore'] ELSE [] END) AS f FROM cfg)""",
)
def _(spark, d):
    return inventory.frameworks(config_files(spark, d))


@query(
    "src7_dependencies",
    f"""WITH {CONFIG_FILES}, x AS (SELECT app_name, path, unnest(CASE p_size % 10
      WHEN 0 THEN [['java', 'org.' || p_type || ':spring-boot', CAST(p_size AS VARCHAR), 'compile'], ['java', 'g:' || p_brand, NULL, 'test']]
      WHEN 1 THEN [['java', 'org.' || p_type || ':hibernate-core', CAST(p_size AS VARCHAR), 'compile'], ['java', 'junit:junit', '4', 'test']]
      WHEN 2 THEN [['java', 'org.spring:spring-data-jpa', NULL, 'runtime']]
      WHEN 3 THEN [['javascript', 'express', '^' || p_size, 'compile'], ['javascript', lower(p_brand), '1', 'compile'], ['javascript', 'react', '18', 'dev']]
      WHEN 4 THEN [['python', 'Django', '>=' || p_size, 'compile'], ['python', 'uvicorn', '0.24', 'compile']]
      WHEN 6 THEN [['python', 'flask', CAST(p_size AS VARCHAR), 'compile'], ['python', 'fastapi', NULL, 'compile']]
      WHEN 7 THEN [['csharp', 'EntityFramework', CAST(p_size AS VARCHAR), 'compile'], ['csharp', p_brand, '2', 'compile']] ELSE [] END) AS v
      FROM (SELECT DISTINCT ON (app_name, path, text) * FROM cfg))
    SELECT app_name, path, v[1] AS language, v[2] AS name, v[3] AS version, v[4] AS scope FROM x""",
)
def _(spark, d):
    return inventory.dependencies(config_files(spark, d))


@query(
    "src8_graph_merge",
    f"""WITH {SHOP_NODES}, a AS (SELECT fqn, name, 0 AS rank, 0 AS seq FROM g_nodes
      UNION ALL SELECT 's:' || l_suppkey, 'seen ' || l_orderkey, 1, l_orderkey * 10 + l_linenumber FROM lineitem)
    SELECT fqn, max_by(name, struct_pack(r := rank, s := seq, n := name)) AS name FROM a GROUP BY 1""",
)
def _(spark, d):
    from graphlens.functions.scale import last_by

    g = shop_graph(spark, d)
    seen = table(spark, d, "lineitem").selectExpr("'shop' AS app_name", "concat('s:', l_suppkey) AS fqn", "concat('seen ', l_orderkey) AS name", "l_orderkey * 10 + l_linenumber AS seq")
    later = Graph(node_rows(last_by(seen, ["app_name", "fqn"], ["seq", "name"])), g.edges.limit(0))
    return merge(g, later).nodes.select("fqn", "name")


@query(
    "src9_index_occurrences",
    """SELECT 'o' || l_orderkey AS relative_path, 's' || l_suppkey AS symbol, l_linenumber AS start_line, CAST(l_partkey % 80 AS INTEGER) AS start_col,
      CASE WHEN l_returnflag = 'R' THEN l_linenumber + 3 ELSE l_linenumber END AS end_line, CAST(CASE WHEN l_returnflag = 'R' THEN l_partkey % 9 ELSE l_partkey % 80 + 5 END AS INTEGER) AS end_col FROM lineitem""",
)
def _(spark, d):
    one = (
        "CASE WHEN l_returnflag = 'R' THEN array(l_linenumber, CAST(l_partkey % 80 AS INT), l_linenumber + 3, CAST(l_partkey % 9 AS INT)) "
        "ELSE array(l_linenumber, CAST(l_partkey % 80 AS INT), CAST(l_partkey % 80 + 5 AS INT)) END"
    )
    index = table(spark, d, "lineitem").selectExpr(
        f"array(named_struct('relative_path', concat('o', l_orderkey), 'occurrences', array(named_struct('range', {one}, 'symbol', concat('s', l_suppkey), 'symbol_roles', 1)))) AS documents"
    )
    return symbols.occurrences(index).drop("roles", "seq")


# --- code view -----------------------------------------------------------------------------


@query(
    "flt8_line_window",
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines, doc_id % 7 + 1 AS at_line FROM documents),
    x AS (SELECT doc_id, at_line, unnest(generate_series(1, len(lines))) AS line_no, unnest(lines) AS line FROM l)
    SELECT CAST(doc_id AS VARCHAR) AS path, CAST(line_no AS INTEGER) AS line_no, line FROM x WHERE line_no BETWEEN greatest(1, at_line - 2) AND at_line + 2""",
)
def _(spark, d):
    docs = table(spark, d, "documents").selectExpr("CAST(doc_id AS STRING) AS path", "text", "doc_id")
    wanted = docs.selectExpr("path", "CAST(doc_id % 7 + 1 AS INT) AS at")
    return symbols.line_windows(docs, wanted, context=2).drop("at")


@query(
    "flt8_node_source",
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), x AS (SELECT doc_id, unnest(generate_series(1, len(lines))) AS line_no, unnest(lines) AS line FROM l)
    SELECT 'f' || doc_id AS fqn, CAST(line_no AS INTEGER) AS line_no, line FROM x WHERE line_no BETWEEN doc_id % 5 + 1 AND doc_id % 5 + 200""",
)
def _(spark, d):
    docs = table(spark, d, "documents").selectExpr("CAST(doc_id AS STRING) AS path", "text", "doc_id")
    nodes = node_rows(docs.selectExpr("concat('f', doc_id) AS fqn", "path", "CAST(doc_id % 5 + 1 AS INT) AS line", "100000 AS end_line"))
    return symbols.node_source(Graph(nodes, edge_rows(nodes.limit(0).selectExpr("fqn AS src", "fqn AS dst"))), docs)


GREP = """SELECT CAST(doc_id AS VARCHAR) AS path, CAST(line_no AS INTEGER) AS line_no, line FROM (SELECT doc_id, unnest(generate_series(1, len(lines))) AS line_no, unnest(lines) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)) WHERE regexp_matches(line, '(the|and) [a-z]+ing')"""


@query("flt22_grep_total", f"SELECT count(*) AS hits, count(DISTINCT path) AS files FROM ({GREP})")
def _(spark, d):
    docs = table(spark, d, "documents").selectExpr("CAST(doc_id AS STRING) AS path", "text")
    return symbols.grep(docs, "(the|and) [a-z]+ing").agg(F.count("*").alias("hits"), F.count_distinct("path").alias("files"))


@query("flt22_grep_hits", f"{GREP} ORDER BY path, line_no LIMIT 20")
def _(spark, d):
    docs = table(spark, d, "documents").selectExpr("CAST(doc_id AS STRING) AS path", "text")
    return symbols.grep(docs, "(the|and) [a-z]+ing").orderBy("path", "line_no").limit(20)


# --- sinks ---------------------------------------------------------------------------------


def _fresh(spark):
    return f"{shared_dir(spark)}/graphlens/store-{uuid.uuid4().hex}"


@query("snk1_stored_nodes", f"WITH {SHOP_NODES} SELECT kind, count(*) AS rows, CAST(sum(coalesce(loc, 0)) AS BIGINT) AS loc FROM g_nodes GROUP BY 1")
def _(spark, d):
    folder = _fresh(spark)
    sinks.write_graph(shop_graph(spark, d), folder)
    return sinks.read_graph(spark, folder).nodes.groupBy("kind").agg(F.count("*").alias("rows"), F.sum(F.coalesce("loc", F.lit(0))).alias("loc"))


@query(
    "snk2_stored_edges",
    f"""WITH {SHOP}, n AS (SELECT fqn FROM g_nodes WHERE NOT coalesce(is_constructor, FALSE))
    SELECT src, dst, kind, min(seq) AS seq FROM g_edges WHERE src IN (SELECT fqn FROM n) AND dst IN (SELECT fqn FROM n) GROUP BY 1, 2, 3""",
)
def _(spark, d):
    g = shop_graph(spark, d)
    kept = Graph(g.nodes.filter(~F.coalesce("is_constructor", F.lit(False))), g.edges)
    return sinks.storable_edges(kept).select("src", "dst", "kind", "seq")


@query("snk3_replaced_project", f"WITH {SHOP_NODES} SELECT kind, count(*) AS rows FROM g_nodes WHERE kind IN ('MODULE', 'CLASS') GROUP BY 1")
def _(spark, d):
    folder = _fresh(spark)
    g = shop_graph(spark, d)
    sinks.write_graph(Graph(g.nodes, g.edges_of("CONTAINS")), folder)
    sinks.replace_project(Graph(g.of_kind("MODULE", "CLASS"), g.edges_of("IMPORTS")), folder, "shop", spark)
    return sinks.read_graph(spark, folder).nodes.groupBy("kind").agg(F.count("*").alias("rows"))


@query(
    "snk4_application_node",
    f"""WITH {FILES}, s AS (SELECT app_name, language, {LOC} AS loc FROM files WHERE app_name NOT IN ('src0', 'src1') AND language IS NOT NULL)
    SELECT app_name, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, count(*) AS total_files, CAST(sum(loc) AS BIGINT) AS total_loc FROM s GROUP BY 1""",
)
def _(spark, d):
    files = inventory.with_loc(inventory.source_files(document_files(spark, d)))
    return sinks.application_node(shop_graph(spark, d), files, inventory.frameworks(config_files(spark, d))).select("app_name", "languages", "total_files", "total_loc")


@query(
    "snk5_stub_hierarchy",
    """WITH t AS (SELECT DISTINCT 'pkg' || l_linenumber || '.K' || l_suppkey AS cls, 'pkg' || l_linenumber || '.K' || l_suppkey || '.m' || l_partkey AS fn FROM lineitem)
    SELECT 'FUNCTION' AS kind, fn AS fqn FROM t UNION ALL SELECT DISTINCT 'CLASS', cls FROM t
    UNION ALL SELECT 'edge', cls || '>' || fn FROM t UNION ALL SELECT DISTINCT 'edge', 'mod' || substr(cls, 4, 1) || '>' || cls FROM t WHERE substr(cls, 4, 1)::INT <= 5""",
)
def _(spark, d):
    line = table(spark, d, "lineitem")
    calls = line.selectExpr("concat('c:', l_orderkey) AS src", "concat('pkg', l_linenumber, '.K', l_suppkey, '.m', l_partkey) AS dst", "'CALLS' AS kind", "l_orderkey AS seq")
    region = table(spark, d, "region")
    modules = region.selectExpr("concat('mod', r_regionkey + 1) AS fqn", "'MODULE' AS kind")
    classes = region.selectExpr("concat('pkg', r_regionkey + 1, '.Known') AS fqn", "'CLASS' AS kind")
    contains = region.selectExpr("concat('mod', r_regionkey + 1) AS src", "concat('pkg', r_regionkey + 1, '.Known') AS dst", "'CONTAINS' AS kind")
    stubs = sinks.stub_hierarchy(Graph(node_rows(modules).union(node_rows(classes)), edge_rows(calls).union(edge_rows(contains))))
    return stubs.nodes.select("kind", "fqn").unionByName(stubs.edges.select(F.lit("edge").alias("kind"), F.concat_ws(">", "src", "dst").alias("fqn")))


@query("snk6_node_export", f"WITH {SHOP_NODES} SELECT fqn, name, kind, language, loc, complexity FROM g_nodes WHERE kind IN ('CLASS', 'FUNCTION')")
def _(spark, d):
    path = _fresh(spark)
    rows = sinks.node_export(shop_graph(spark, d), ["CLASS", "FUNCTION"])
    sinks.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("snk7_edge_export", f"WITH {SHOP_EDGES} SELECT src AS source, dst AS target, kind AS type, coalesce(weight, 1) AS weight FROM g_edges")
def _(spark, d):
    return sinks.edge_export(shop_graph(spark, d))


@query(
    "snk8_json_export",
    f"""WITH {SHOP} SELECT 'node' AS item, count(*) AS rows, CAST(sum(coalesce(loc, 0)) AS BIGINT) AS total FROM g_nodes UNION ALL SELECT 'edge', count(*), count(*) FROM g_edges""",
)
def _(spark, d):
    path = _fresh(spark)
    sinks.json_lines(shop_graph(spark, d)).write.partitionBy("item").text(path)
    back = spark.read.schema("value string, item string").text(path)
    total = F.when(F.col("item") == "node", F.coalesce(F.get_json_object("value", "$.loc").cast("bigint"), F.lit(0))).otherwise(
        F.get_json_object("value", "$.weight").cast("bigint")
    )
    return back.groupBy("item").agg(F.count("*").alias("rows"), F.sum(total).alias("total"))


FILE_PATH = "'src/' || lower(o_orderstatus) || '/' || CASE o_custkey % 3 WHEN 0 THEN 'deep/er/' WHEN 1 THEN 'in.ner/' ELSE '' END || 'f' || o_orderkey || CASE o_orderkey % 2 WHEN 0 THEN '.py' ELSE '_py' END"


@query(
    "flt22_find_files",
    f"""SELECT path, modified FROM (SELECT {FILE_PATH} AS path, CAST(o_orderdate AS VARCHAR) AS modified FROM orders)
    WHERE regexp_full_match(path, 'src/[of]/([^/]+/)*f[0-9][^/]*[.]py') ORDER BY modified DESC, path LIMIT 100""",
)
def _(spark, d):
    files = table(spark, d, "orders").selectExpr(f"{FILE_PATH} AS path", "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS modified")
    return symbols.find_files(files, "src/[of]/**/f[0-9]*.py")
