"""Change-set questions: orders are diffs, a nation's orders of one status are one pull request."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.functions import text
from graphlens.graph import Graph
from graphlens.operators import change
from graphlens.plans.derived import SHOP, shop_graph, shop_nodes
from graphlens.plans.registry import query, table
from graphlens.plans.traverse_queries import DOWN, LABEL, REGION_DEP, UP, region_imports

DIFF_COLUMNS = """'pr' || c_nationkey || o_orderstatus AS pr_id,
  CASE o_orderpriority WHEN '5-LOW' THEN 'moved:' || c_nationkey WHEN '4-NOT SPECIFIED' THEN 'new/' || o_orderkey
    WHEN '3-MEDIUM' THEN 'nation:' || (c_nationkey + 1) ELSE 'nation:' || c_nationkey END AS path,
  CASE o_orderpriority WHEN '5-LOW' THEN 'renamed' WHEN '4-NOT SPECIFIED' THEN 'added' WHEN '3-MEDIUM' THEN 'deleted' ELSE 'modified' END AS status,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'nation:' || c_nationkey END AS old_path,
  CAST(o_orderkey % 1000 * 10 AS INT) AS new_start, CAST(o_orderkey % 7 + 1 AS INT) AS new_count"""
DIFF = f"""diff AS MATERIALIZED (SELECT {DIFF_COLUMNS} FROM orders JOIN customer ON o_custkey = c_custkey),
  node AS MATERIALIZED (SELECT fqn, name, {LABEL} AS type, path, line, end_line FROM g_nodes n WHERE kind IN ('CLASS', 'FUNCTION')),
  changed AS MATERIALIZED (
    SELECT DISTINCT d.pr_id, d.path, n.fqn, n.name, n.type, d.status AS change_type FROM diff d JOIN node n
      ON n.path = coalesce(d.old_path, d.path) AND n.line <= d.new_start + d.new_count - 1 AND n.end_line >= d.new_start
      WHERE d.status IN ('modified', 'renamed')
    UNION SELECT d.pr_id, d.path, n.fqn, n.name, n.type, d.status FROM diff d JOIN node n ON n.path = d.path WHERE d.status = 'deleted')"""


def pull_requests(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    rows = joined.selectExpr(*[c.strip() for c in _split(DIFF_COLUMNS)], "o_orderkey AS seq")
    hunks = F.array(F.struct(
        F.col("new_start").alias("old_start"), F.col("new_count").alias("old_count"), F.col("new_start"), F.col("new_count")
    ))
    return rows.select("pr_id", "path", "status", "old_path", hunks.alias("hunks"), "new_count", "seq")


def _split(columns):
    """Top-level commas only; none of the expressions holds a comma outside parentheses."""
    return columns.split(",\n")[:-1] + columns.split(",\n")[-1].split(", CAST")[:1] + ["CAST" + columns.split(", CAST")[-1]]


def _changed(spark, d):
    return change.map_diffs(shop_graph(spark, d), pull_requests(spark, d))


@query(
    "jn9_hunk_overlap",
    f"""WITH {SHOP}, {DIFF} SELECT DISTINCT d.pr_id, n.fqn FROM diff d JOIN node n ON n.path = d.path
      AND n.line <= d.new_start + d.new_count - 1 AND n.end_line >= d.new_start WHERE d.status = 'modified'""",
)
def _(spark, d):
    hunks = pull_requests(spark, d).filter("status = 'modified'").selectExpr(
        "pr_id", "path AS query_path", "hunks[0].new_start AS new_start", "hunks[0].new_start + hunks[0].new_count - 1 AS new_end"
    )
    return change.nodes_in_hunks(shop_graph(spark, d), hunks).select("pr_id", "fqn").distinct()


@query("jn10_nodes_of_files", f"WITH {SHOP}, {DIFF} SELECT DISTINCT d.pr_id, n.fqn, n.type FROM diff d JOIN node n ON n.path = d.path WHERE d.status = 'deleted'")
def _(spark, d):
    files = pull_requests(spark, d).filter("status = 'deleted'").selectExpr("pr_id", "path AS query_path").distinct()
    return change.nodes_in_files(shop_graph(spark, d), files).select("pr_id", "fqn", "type")


@query("jn11_changed_nodes", f"WITH {SHOP}, {DIFF} SELECT pr_id, path, fqn, name, type, change_type FROM changed")
def _(spark, d):
    return _changed(spark, d)[0]


@query(
    "jn11_file_outcomes",
    f"""WITH {SHOP}, {DIFF} SELECT pr_id, path, CASE status WHEN 'added' THEN 'new' ELSE 'deleted' END AS outcome FROM diff WHERE status IN ('added', 'deleted')
    UNION ALL SELECT DISTINCT pr_id, path, 'non_graph' FROM diff d WHERE status IN ('modified', 'renamed')
      AND NOT EXISTS (SELECT 1 FROM changed c WHERE c.pr_id = d.pr_id AND c.path = d.path)""",
)
def _(spark, d):
    return _changed(spark, d)[1]


@query("agg31_diff_totals", f"WITH {SHOP}, {DIFF} SELECT pr_id, CAST(sum(new_count) AS BIGINT) AS additions, CAST(sum(new_count * 2) AS BIGINT) AS deletions, count(*) AS files FROM diff GROUP BY 1")
def _(spark, d):
    return change.diff_totals(pull_requests(spark, d).selectExpr("pr_id", "new_count AS additions", "new_count * 2 AS deletions"))


@query(
    "agg16_changed_node_fan_in",
    f"""WITH {SHOP}, {DIFF}, f AS (SELECT dst, count(DISTINCT src) AS n FROM g_edges WHERE kind = 'CALLS' GROUP BY 1)
    SELECT DISTINCT pr_id, fqn, coalesce(n, 0) AS fan_in FROM changed LEFT JOIN f ON dst = fqn""",
)
def _(spark, d):
    g = shop_graph(spark, d)
    return change.changed_enriched(g, change.map_diffs(g, pull_requests(spark, d))[0]).drop("is_hub")


IMPACT = f"""{DIFF}, dhop AS MATERIALIZED (SELECT DISTINCT src, dst FROM g_edges WHERE kind IN {DOWN}),
  uhop AS MATERIALIZED (SELECT DISTINCT src, dst FROM g_edges WHERE kind IN {UP}),
  touched AS (SELECT DISTINCT pr_id, fqn FROM changed),
  down(pr_id, node, depth) AS (SELECT DISTINCT pr_id, dst, 1 FROM touched JOIN dhop ON src = fqn
    UNION SELECT w.pr_id, h.dst, w.depth + 1 FROM down w JOIN dhop h ON h.src = w.node WHERE w.depth < 5),
  inside(pr_id, node, depth) AS (SELECT pr_id, fqn, 0 FROM touched
    UNION SELECT i.pr_id, e.dst, i.depth + 1 FROM inside i JOIN g_edges e ON e.src = i.node AND e.kind = 'CONTAINS' WHERE i.depth < 10),
  up(pr_id, node, depth) AS (SELECT DISTINCT i.pr_id, h.src, 1 FROM inside i JOIN uhop h ON h.dst = i.node
    UNION SELECT u.pr_id, h.src, u.depth + 1 FROM up u JOIN uhop h ON h.dst = u.node WHERE u.depth < 5),
  affected AS MATERIALIZED (SELECT pr_id, node AS fqn, min_by(depth, rank * 100 + depth) AS depth FROM (SELECT pr_id, node, depth, 0 AS rank FROM down
      UNION ALL SELECT DISTINCT pr_id, node, 1, 1 FROM up) x
    WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE t.pr_id = x.pr_id AND t.fqn = x.node) GROUP BY 1, 2)"""


def _affected(spark, d):
    g = shop_graph(spark, d)
    changed, files = change.map_diffs(g, pull_requests(spark, d))
    return g, changed, files, change.unique_affected(change.impact_sets(g, changed))


@query("agg15_pr_blast_radius", f"WITH RECURSIVE {SHOP}, {IMPACT} SELECT pr_id, fqn, depth FROM affected")
def _(spark, d):
    return _affected(spark, d)[3].spread("pr_id")


@query(
    "agg15_pr_breakdown",
    f"""WITH RECURSIVE {SHOP}, {IMPACT}, t AS (SELECT a.pr_id, {LABEL} AS type, a.depth, n.layer FROM affected a JOIN g_nodes n ON n.fqn = a.fqn)
    SELECT pr_id, 'total' AS grouping, 'all' AS value, count(*) AS nodes FROM t GROUP BY 1
    UNION ALL SELECT pr_id, 'type', type, count(*) FROM t GROUP BY 1, 3
    UNION ALL SELECT pr_id, 'depth', CAST(depth AS VARCHAR), count(*) FROM t GROUP BY 1, 3
    UNION ALL SELECT pr_id, 'layer', layer, count(*) FROM t WHERE layer IS NOT NULL GROUP BY 1, 3""",
)
def _(spark, d):
    g, _changed_nodes, _files, affected = _affected(spark, d)
    return change.impact_breakdown(g, affected)


@query(
    "agg33_risk_level",
    f"""WITH RECURSIVE {SHOP}, {IMPACT}, f AS (SELECT dst, count(DISTINCT src) AS n FROM g_edges WHERE kind = 'CALLS' GROUP BY 1),
    c AS (SELECT pr_id, coalesce(max(n), 0) AS fan FROM touched LEFT JOIN f ON dst = fqn GROUP BY 1),
    b AS (SELECT pr_id, count(*) AS blast, count(DISTINCT layer) AS layers FROM affected a JOIN g_nodes n ON n.fqn = a.fqn GROUP BY 1),
    callee(pr_id, node) AS (SELECT pr_id, fqn FROM touched UNION SELECT k.pr_id, e.dst FROM callee k JOIN g_edges e ON e.src = k.node AND e.kind = 'CALLS'),
    x AS (SELECT pr_id, count(DISTINCT p_name) AS crossed FROM callee JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON node = 's:' || l_suppkey
      JOIN part ON p_partkey = l_partkey GROUP BY 1),
    s AS (SELECT c.pr_id, blast, fan, crossed, CASE WHEN blast > 50 THEN 3 WHEN blast > 20 THEN 2 WHEN blast > 5 THEN 1 ELSE 0 END
      + CASE WHEN crossed > 3 THEN 2 WHEN crossed > 0 THEN 1 ELSE 0 END + CASE WHEN fan > 15 THEN 2 WHEN fan > 5 THEN 1 ELSE 0 END
      + CASE WHEN layers >= 3 THEN 1 ELSE 0 END AS score FROM c LEFT JOIN b USING (pr_id) LEFT JOIN x USING (pr_id))
    SELECT pr_id, blast AS blast_radius, crossed AS cross_tech, fan AS max_fan_in, score,
      CASE WHEN score >= 7 THEN 'High' WHEN score >= 3 THEN 'Medium' ELSE 'Low' END AS risk_level FROM s""",
)
def _(spark, d):
    g, changed, _files, affected = _affected(spark, d)
    cross = change.cross_technology_impacts(g, changed)
    report = change.risk_report(g, changed, affected, cross)
    return report.select("pr_id", "blast_radius", "cross_tech", "max_fan_in", "score", "risk_level")


HOMES = """homes AS (SELECT 'r:' || n_regionkey AS module, r_name, 'n:' || n_nationkey AS fqn FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT 'r:' || n_regionkey, r_name, 'c:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT 'r:' || n_regionkey, r_name, 's:' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey)"""
NEW_DEPS = f"""new_deps AS (SELECT DISTINCT c.pr_id, a.r_name AS from_module, b.r_name AS to_module FROM changed c JOIN homes a ON a.fqn = c.fqn
  JOIN g_edges e ON e.src = c.fqn AND e.kind IN ('CALLS', 'DEPENDS_ON', 'INJECTS') JOIN homes b ON b.fqn = e.dst
  WHERE a.module <> b.module AND NOT EXISTS (SELECT 1 FROM dep WHERE dep.src = a.r_name AND dep.dst = b.r_name)
  AND NOT (a.module = 'r:0' AND b.module = 'r:1'))"""


def _drift_graph(spark, d):
    g = shop_graph(spark, d)
    return Graph(g.nodes, g.edges.unionByName(region_imports(spark, d)))


def _drift_input(spark, d):
    g = _drift_graph(spark, d)
    changed, files = change.map_diffs(g, pull_requests(spark, d))
    return g, changed, files


@query("agg32_changed_modules", f"WITH {SHOP}, {DIFF}, {HOMES} SELECT DISTINCT c.pr_id, module, c.fqn FROM changed c JOIN homes h ON h.fqn = c.fqn")
def _(spark, d):
    g, changed, _files = _drift_input(spark, d)
    return change.changed_modules(change.containing_modules(g), changed)


@query("jn38_new_module_dependencies", f"WITH {SHOP}, {DIFF}, {HOMES}, {REGION_DEP}, {NEW_DEPS} SELECT pr_id, from_module, to_module FROM new_deps")
def _(spark, d):
    g, changed, _files = _drift_input(spark, d)
    return change.new_module_dependencies(g, change.containing_modules(g), changed)


DRIFT_WALK = """mdep AS MATERIALIZED (SELECT src, dst FROM dep UNION SELECT a.r_name, b.r_name FROM region a, region b WHERE a.r_regionkey = 0 AND b.r_regionkey = 1),
  walk(start, last, cycle, used, len) AS (SELECT src, dst, [src, dst], [src || '>' || dst], 1 FROM mdep
    UNION ALL SELECT start, e.dst, list_append(cycle, e.dst), list_append(used, e.src || '>' || e.dst), len + 1
    FROM walk w JOIN mdep e ON e.src = w.last WHERE len < 6 AND NOT list_contains(used, e.src || '>' || e.dst)),
  trail AS (SELECT DISTINCT start, array_to_string(cycle, ' > ') AS cycle FROM walk WHERE start = last AND len >= 2),
  pr_cycle AS (SELECT DISTINCT c.pr_id, t.cycle FROM changed c JOIN homes h ON h.fqn = c.fqn JOIN trail t ON t.start = h.r_name)"""


@query("g13_drift_cycles", f"WITH RECURSIVE {SHOP}, {DIFF}, {HOMES}, {REGION_DEP}, {DRIFT_WALK} SELECT pr_id, cycle FROM pr_cycle")
def _(spark, d):
    g, changed, _files = _drift_input(spark, d)
    return change.drift_cycles(g, change.containing_modules(g), changed)


@query(
    "g14_drift_report",
    f"""WITH RECURSIVE {SHOP}, {DIFF}, {HOMES}, {REGION_DEP}, {NEW_DEPS}, {DRIFT_WALK}
    SELECT pr_id, 'new_dependency' AS finding, from_module || ' -> ' || to_module AS detail FROM new_deps
    UNION ALL SELECT pr_id, 'cycle', cycle FROM pr_cycle UNION ALL SELECT pr_id, 'new_file', path FROM diff WHERE status = 'added'""",
)
def _(spark, d):
    g, changed, files = _drift_input(spark, d)
    return change.drift_report(g, changed, files)


@query(
    "g15_pr_analysis",
    f"""WITH RECURSIVE {SHOP}, {IMPACT}, {HOMES}, {REGION_DEP}, {NEW_DEPS}
    SELECT pr_id, (SELECT count(*) FROM touched t WHERE t.pr_id = p.pr_id) AS changed_nodes,
      (SELECT count(*) FROM affected a WHERE a.pr_id = p.pr_id) AS blast_radius,
      (SELECT count(*) FROM new_deps n WHERE n.pr_id = p.pr_id) AS new_dependencies FROM (SELECT DISTINCT pr_id FROM changed) p""",
)
def _(spark, d):
    g = _drift_graph(spark, d)
    parts = change.analyse_pull_requests(g, pull_requests(spark, d))
    deps = parts["new_dependencies"].groupBy("pr_id").agg(F.count("*").alias("new_dependencies"))
    return parts["sizes"].join(deps, "pr_id", "left").na.fill(0, ["new_dependencies"])


@query("g16_mark_stale", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND c_acctbal > 0 THEN 'stale' ELSE CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'pending' END END AS status FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    analyses = table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_custkey AS repository_id", "CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'pending' END AS status")
    rebuilt = table(spark, d, "customer").filter("c_acctbal > 0").selectExpr("c_custkey AS repository_id")
    return change.mark_stale(analyses, rebuilt).select("id", "status")


# --- triage ------------------------------------------------------------------------------

PATHS = """CASE p_size % 12 WHEN 0 THEN 'src/main/java/com/' || lower(p_brand) || '/' || replace(p_name, ' ', '') || '.java'
  WHEN 1 THEN 'tests/unit/test_' || p_partkey || '.py' WHEN 2 THEN lower(p_type) || '/tests/' || p_partkey || '.py' WHEN 3 THEN 'Dockerfile'
  WHEN 4 THEN '.github/workflows/' || p_partkey || '.yml' WHEN 5 THEN 'conf/' || p_partkey || '.yaml' WHEN 6 THEN 'db/migrations/V' || p_partkey || '__init.sql'
  WHEN 7 THEN 'docs/' || p_partkey || '.md' WHEN 8 THEN 'app/' || lower(p_type) || '/deep/' || p_partkey || '.py' WHEN 9 THEN p_partkey || '.xyz'
  WHEN 10 THEN 'lib\\' || lower(p_type) || '\\m\\' || p_partkey || '.ts' ELSE 'src/' || lower(p_type) || '/App.spec.ts' END"""


def _category_sql(path):
    clean = f"replace({path}, '\\', '/')"
    base = f"split_part({clean}, '/', -1)"
    whens = " ".join(
        "WHEN " + " OR ".join(f"{clean} GLOB '{g}' OR {base} GLOB '{g}'" for g in globs) + f" THEN '{name}'"
        for name, globs in change.FILE_CATEGORIES
    )
    return f"CASE {whens} ELSE 'source' END"


@query("flt14_file_category", f"SELECT p_partkey, path, {_category_sql('path')} AS category FROM (SELECT p_partkey, {PATHS} AS path FROM part)")
def _(spark, d):
    paths = table(spark, d, "part").selectExpr("p_partkey", PATHS.replace("\\", "\\\\") + " AS path")
    return paths.withColumn("category", change.file_category(F.col("path")))


MODULE_SQL = """list_extract(string_split(clean, '/'), CASE WHEN len(string_split(clean, '/')) > 2 THEN len(string_split(clean, '/')) - 1 ELSE 1 END)"""
CLEAN = "regexp_replace(replace(path, '\\', '/'), '^(src/main/java/|src/main/kotlin/|src/main/scala/|src/main/resources/|src/|app/|lib/|pkg/)', '')"


@query(
    "flt15_module_of_path",
    f"""SELECT p_partkey, CASE WHEN contains(clean, '/') THEN {MODULE_SQL} ELSE 'root' END AS module,
      array_to_string(string_split('com.' || p_type || '.x.y', '.')[1:3], '.') AS fqn_module
    FROM (SELECT p_partkey, p_type, {CLEAN} AS clean FROM (SELECT p_partkey, p_type, {PATHS} AS path FROM part))""",
)
def _(spark, d):
    paths = table(spark, d, "part").selectExpr("p_partkey", "concat('com.', p_type, '.x.y') AS fqn", PATHS.replace("\\", "\\\\") + " AS path")
    return paths.select("p_partkey", text.module_of_path(F.col("path")).alias("module"), text.module_of_fqn(F.col("fqn")).alias("fqn_module"))


BATCH = """f AS (SELECT 'pr' || c_mktsegment AS pr_id, 'src/' || c_nationkey || '/' || c_custkey || '.py' AS path, c_custkey AS seq, CAST(c_nationkey AS VARCHAR) AS module FROM customer),
  p AS (SELECT *, (row_number() OVER (PARTITION BY pr_id, module ORDER BY seq, path) - 1) // 5 AS chunk FROM f),
  b AS (SELECT pr_id, module, chunk, row_number() OVER (PARTITION BY pr_id ORDER BY module, chunk) - 1 AS batch, count(*) AS size FROM p GROUP BY 1, 2, 3)"""


def _batches(spark, d):
    files = table(spark, d, "customer").selectExpr("concat('pr', c_mktsegment) AS pr_id", "concat('src/', c_nationkey, '/', c_custkey, '.py') AS path", "c_custkey AS seq")
    none = shop_nodes(spark, d).limit(0).select(F.lit("").alias("pr_id"), "path", "fqn")
    return change.triage_batches(files, none)


@query("win7_triage_batches", f"WITH {BATCH} SELECT p.pr_id, CAST(batch AS INTEGER) AS batch, p.module, path FROM p JOIN b ON b.pr_id = p.pr_id AND b.module = p.module AND b.chunk = p.chunk")
def _(spark, d):
    return _batches(spark, d)


@query("win8_merged_batches")
def _(spark, d):
    return change.merged_batches(_batches(spark, d))


@query("win8_merged_counts", f"WITH {BATCH} SELECT pr_id, count(*) AS batches, least(count(*), 5) AS merged FROM b GROUP BY 1")
def _(spark, d):
    rows = change.merged_batches(_batches(spark, d))
    return rows.groupBy("pr_id").agg(F.count("*").alias("batches"), F.count_distinct("merged").alias("merged"))


CHANGED_BATCH = """f AS (SELECT DISTINCT pr_id, path FROM diff), m AS (SELECT pr_id, path, min(fqn) AS fqn FROM changed GROUP BY 1, 2),
  h AS (SELECT f.pr_id, f.path, coalesce(m.fqn, CASE WHEN contains(f.path, '/') THEN split_part(f.path, '/', 1) ELSE 'root' END) AS module
    FROM f LEFT JOIN m ON m.pr_id = f.pr_id AND m.path = f.path),
  p AS (SELECT *, (row_number() OVER (PARTITION BY pr_id, module ORDER BY path) - 1) // 5 AS chunk FROM h),
  b AS (SELECT pr_id, module, chunk, row_number() OVER (PARTITION BY pr_id ORDER BY module, chunk) - 1 AS batch FROM p GROUP BY 1, 2, 3)"""


@query(
    "win7_batches_of_changes",
    f"WITH {SHOP}, {DIFF}, {CHANGED_BATCH} SELECT p.pr_id, CAST(batch AS INTEGER) AS batch, p.module, path FROM p JOIN b ON b.pr_id = p.pr_id AND b.module = p.module AND b.chunk = p.chunk",
)
def _(spark, d):
    """Files with changed nodes go to the module of the first one."""
    files = pull_requests(spark, d).select("pr_id", "path").distinct().withColumn("seq", F.lit(0))
    return change.triage_batches(files, _changed(spark, d)[0])
