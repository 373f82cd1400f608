"""Operational roll-ups: orders are analysis runs, events are activity, conversations are model usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.functions import text
from graphlens.operators import usage
from graphlens.plans.registry import query, table

AS_OF = "2024-01-31 00:00:00"
RUNS = """runs AS (SELECT o_orderkey AS id, o_custkey AS project_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'completed' ELSE 'failed' END AS status,
    o_orderdate AS completed_at, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(floor(o_totalprice) AS BIGINT) END AS total_loc,
    o_orderkey % 97 AS node_count, o_orderkey % 89 AS edge_count FROM orders),
  projects AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS repository_id, CASE WHEN c_acctbal > 500 THEN c_mktsegment END AS branch, c_name AS name FROM customer),
  latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY completed_at DESC, id DESC) AS r FROM runs
    WHERE status = 'completed' AND total_loc IS NOT NULL) WHERE r = 1),
  branches AS (SELECT repository_id, coalesce(branch, 'unknown') AS branch, project_id, total_loc FROM latest JOIN projects p ON p.id = project_id WHERE repository_id IS NOT NULL),
  billable AS (SELECT n_nationkey AS repository_id, coalesce(max(total_loc), 0) AS billable_loc, max_by(project_id, struct_pack(a := total_loc, b := -project_id)) AS max_loc_project_id,
    max_by(branch, struct_pack(a := total_loc, b := -project_id)) AS max_loc_branch_name, count(DISTINCT branch) AS branches FROM nation LEFT JOIN branches ON repository_id = n_nationkey GROUP BY 1)"""


def runs(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS project_id", "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'completed' ELSE 'failed' END AS status",
        "o_orderdate AS completed_at", "CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(floor(o_totalprice) AS BIGINT) END AS total_loc",
        "o_orderkey % 97 AS node_count", "o_orderkey % 89 AS edge_count", "CASE WHEN o_totalprice > 100000 THEN o_orderpriority END AS snapshot",
    )


def projects(spark, d):
    return table(spark, d, "customer").selectExpr(
        "c_custkey AS id", "CASE WHEN c_acctbal > 0 THEN c_nationkey END AS repository_id", "CASE WHEN c_acctbal > 500 THEN c_mktsegment END AS branch", "c_name AS name"
    )


def repositories(spark, d):
    return table(spark, d, "nation").selectExpr("n_nationkey AS id", "n_name AS name", "make_date(2024, 1, n_nationkey + 1) AS created_at")


@query("win2_latest_run", f"WITH {RUNS} SELECT project_id, id, total_loc FROM latest")
def _(spark, d):
    return usage.latest_runs(runs(spark, d)).select("project_id", "id", "total_loc")


@query("agg22_branch_breakdown", f"WITH {RUNS} SELECT repository_id, branch, project_id, total_loc FROM branches")
def _(spark, d):
    return usage.branch_loc(runs(spark, d), projects(spark, d))


@query("agg22_billable_loc", f"WITH {RUNS} SELECT * FROM billable")
def _(spark, d):
    return usage.billable_loc(runs(spark, d), projects(spark, d), repositories(spark, d))


@query(
    "agg23_cumulative_loc",
    f"""WITH {RUNS} SELECT CAST((SELECT sum(billable_loc) FROM billable) + coalesce((SELECT sum(total_loc) FROM latest JOIN projects p ON p.id = project_id
      WHERE repository_id IS NULL), 0) AS BIGINT) AS cumulative_loc""",
)
def _(spark, d):
    return usage.cumulative_loc(runs(spark, d), projects(spark, d), repositories(spark, d))


@query("agg24_loc_breakdown", f"WITH {RUNS} SELECT n_name AS name, billable_loc FROM billable JOIN nation ON n_nationkey = repository_id WHERE billable_loc > 0")
def _(spark, d):
    names = repositories(spark, d).select(F.col("id").alias("repository_id"), "name")
    rows = usage.billable_loc(runs(spark, d), projects(spark, d), repositories(spark, d)).filter("billable_loc > 0")
    return rows.join(names, "repository_id").select("name", "billable_loc").orderBy(F.desc("billable_loc"), "name")


QUOTA = """q AS (SELECT c_custkey AS subject, CASE WHEN c_acctbal > -500 THEN (TIMESTAMP '2024-01-31 00:00:00' + INTERVAL 1 DAY * (c_custkey % 90 - 30)) END AS expires_at,
    CAST(c_nationkey * 1000000 AS BIGINT) AS loc_limit, coalesce(used, 0) AS used
    FROM customer LEFT JOIN (SELECT o_custkey, CAST(floor(sum(o_totalprice)) AS BIGINT) AS used FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


def quotas(spark, d):
    used = table(spark, d, "orders").groupBy("o_custkey").agg(F.floor(F.sum("o_totalprice")).alias("used"))
    rows = table(spark, d, "customer").join(used, F.expr("o_custkey = c_custkey"), "left")
    return rows.selectExpr(
        "c_custkey AS subject",
        f"CASE WHEN c_acctbal > -500 THEN timestamp '{AS_OF}' + make_dt_interval(CAST(c_custkey % 90 - 30 AS INT)) END AS expires_at",
        "CAST(c_nationkey * 1000000 AS BIGINT) AS loc_limit", "coalesce(used, 0) AS used",
    )


STATE = """CASE WHEN expires_at IS NULL THEN 'UNLICENSED' WHEN TIMESTAMP '2024-01-31 00:00:00' >= expires_at + INTERVAL 14 DAY THEN 'BLOCKED'
  WHEN loc_limit > 0 AND used >= loc_limit THEN 'BLOCKED' WHEN TIMESTAMP '2024-01-31 00:00:00' >= expires_at THEN 'GRACE'
  WHEN (loc_limit > 0 AND used >= loc_limit * 0.9) OR expires_at <= TIMESTAMP '2024-01-31 00:00:00' + INTERVAL 30 DAY THEN 'WARN' ELSE 'HEALTHY' END"""


@query("agg25_quota_state", f"WITH {QUOTA} SELECT subject, {STATE} AS state FROM q")
def _(spark, d):
    return usage.usage_report(quotas(spark, d), AS_OF).select("subject", "state")


@query(
    "agg26_usage_report",
    f"""WITH {QUOTA} SELECT subject, CASE WHEN loc_limit > 0 THEN round(used / loc_limit * 100, 1) ELSE 0.0 END AS percent,
      CAST(coalesce(date_diff('day', TIMESTAMP '2024-01-31 00:00:00', expires_at), 0) AS BIGINT) AS days_remaining, 'January 2024' AS month FROM q""",
)
def _(spark, d):
    return usage.usage_report(quotas(spark, d), AS_OF).drop("state")


@query(
    "agg30_repository_list",
    f"""WITH {RUNS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY completed_at DESC, id DESC) AS r FROM runs WHERE status = 'completed') WHERE r = 1)
    SELECT n_nationkey AS repository_id, billable_loc, p.id AS project_id, branch, node_count, edge_count FROM nation JOIN billable b ON b.repository_id = n_nationkey
    LEFT JOIN projects p ON p.repository_id = n_nationkey LEFT JOIN l ON l.project_id = p.id""",
)
def _(spark, d):
    return usage.repository_list(repositories(spark, d), projects(spark, d), runs(spark, d)).drop("created_at")


@query(
    "flt20_evolution_timeline",
    f"""WITH {RUNS} SELECT r.id, r.completed_at FROM runs r JOIN orders ON o_orderkey = r.id JOIN projects p ON p.id = project_id
    WHERE status = 'completed' AND o_totalprice > 100000 AND repository_id = 3 AND branch = 'BUILDING'""",
)
def _(spark, d):
    return usage.evolution_timeline(runs(spark, d), projects(spark, d), 3, "BUILDING").select("id", "completed_at")


@query(
    "flt17_pull_request_page",
    "SELECT o_orderkey AS id FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 1",
)
def _(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_custkey AS repository_id", "o_orderstatus AS status", "o_orderpriority AS risk_level", "o_orderdate AS created_at")
    return usage.pull_request_page(rows, 7, status="F", offset=1).select("id")


# --- activity -----------------------------------------------------------------------------


def activity(spark, d):
    return table(spark, d, "events").selectExpr(
        "event_id AS id", "CASE WHEN user_id <> 0 THEN user_id END AS user_id",
        "concat(event_type, '.', CASE WHEN value > 10 THEN 'large' ELSE 'small' END) AS action", "ts AS created_at",
    )


ACTIVITY = """log AS (SELECT event_id AS id, CASE WHEN user_id <> 0 THEN user_id END AS user_id, event_type || '.' || CASE WHEN value > 10 THEN 'large' ELSE 'small' END AS action,
  ts AS created_at FROM events), recent AS (SELECT * FROM log WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY)"""


@query(
    "flt16_activity_feed",
    f"""WITH {ACTIVITY} SELECT id, action, s_name AS user_name FROM recent LEFT JOIN supplier ON s_suppkey = user_id WHERE starts_with(action, 'click.')
    ORDER BY created_at DESC, id DESC LIMIT 50""",
)
def _(spark, d):
    users = table(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_name AS user_name")
    return usage.activity_feed(activity(spark, d), users, AS_OF, days=10, category="click", limit=50).select("id", "action", "user_name")


@query(
    "agg20_activity_stats",
    f"""WITH {ACTIVITY} SELECT 'total' AS grouping, NULL AS value, count(*) AS n FROM recent UNION ALL SELECT 'action', action, count(*) FROM recent GROUP BY action
    UNION ALL SELECT 'day', CAST(CAST(created_at AS DATE) AS VARCHAR), count(*) FROM recent GROUP BY 2""",
)
def _(spark, d):
    return usage.activity_stats(activity(spark, d), AS_OF, 10)


@query("agg20_unique_users", f"WITH {ACTIVITY} SELECT count(DISTINCT user_id) AS unique_users FROM recent")
def _(spark, d):
    return usage.unique_users(activity(spark, d), AS_OF, 10)


# --- model usage --------------------------------------------------------------------------


def ai_usage(spark, d):
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").alias("project_id"), F.col("role").alias("source"), F.col("turn").alias("id"),
        F.length("text").cast("bigint").alias("input_tokens"), (F.length("text") * 3 % 1000).cast("bigint").alias("output_tokens"),
        F.col("turn").alias("created_at"),
    )
    return rows.withColumn("estimated_cost_usd", text.usage_cost(F.col("input_tokens"), F.col("output_tokens"), "3.0", "15.0"))


AI = """log AS (SELECT conv_id AS project_id, role AS source, turn, CAST(length(text) AS BIGINT) AS i, CAST(length(text) * 3 % 1000 AS BIGINT) AS o,
  round(CAST(length(text) AS DECIMAL(18,0)) * 3 + CAST(length(text) * 3 % 1000 AS DECIMAL(18,0)) * 15, 0) AS micro FROM conversations)"""


@query("fn_usage_cost", f"WITH {AI} SELECT project_id, turn, CAST(micro AS DOUBLE) / 1000000 AS cost FROM log")
def _(spark, d):
    return ai_usage(spark, d).select("project_id", F.col("id").alias("turn"), F.col("estimated_cost_usd").cast("double").alias("cost"))


USAGE = "count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(micro) AS DOUBLE) / 1000000 AS cost"


@query("agg21_usage_totals", f"WITH {AI} SELECT {USAGE} FROM log")
def _(spark, d):
    return usage.usage_totals(ai_usage(spark, d), []).withColumn("cost", F.col("cost").cast("double"))


@query("agg21_usage_by_source", f"WITH {AI} SELECT source, {USAGE} FROM log GROUP BY source")
def _(spark, d):
    return usage.usage_totals(ai_usage(spark, d), ["source"]).withColumn("cost", F.col("cost").cast("double"))


@query("agg21_usage_by_project", f"WITH {AI} SELECT project_id, c_name AS project_name, {USAGE} FROM log JOIN customer ON c_custkey = project_id GROUP BY 1, 2")
def _(spark, d):
    names = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name")
    return usage.usage_by_project(ai_usage(spark, d), names).withColumn("cost", F.col("cost").cast("double"))


@query("flt19_project_usage", f"WITH {AI} SELECT turn AS id, source, i AS input_tokens FROM log WHERE project_id = 3 ORDER BY turn DESC LIMIT 20")
def _(spark, d):
    return usage.project_usage(ai_usage(spark, d), 3, 20).select("id", "source", "input_tokens")


@query("flt21_chat_history", "SELECT turn AS id, role, text AS content FROM conversations WHERE conv_id = 5")
def _(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id AS project_id", "turn AS id", "turn AS created_at", "role", "text AS content", "CAST(NULL AS STRING) AS node_fqn")
    return usage.chat_history(rows, 5).select("id", "role", "content")


@query(
    "flt18_new_tags",
    """WITH inc AS (SELECT DISTINCT o_custkey AS project_id, 's:' || l_suppkey AS node_fqn, l_returnflag AS tag_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'),
    old AS (SELECT DISTINCT o_custkey AS project_id, 's:' || l_suppkey AS node_fqn, l_returnflag AS tag_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'O')
    SELECT * FROM inc EXCEPT SELECT * FROM old""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("o_orderkey = l_orderkey")).selectExpr(
        "o_custkey AS project_id", "concat('s:', l_suppkey) AS node_fqn", "l_returnflag AS tag_name", "l_linenumber AS id", "o_orderstatus"
    )
    return usage.new_tags(rows.filter("o_orderstatus <> 'O'"), rows.filter("o_orderstatus = 'O'").drop("o_orderstatus")).drop("id")


@query("flt18_tags_of_node", "SELECT l_orderkey AS project_id, l_returnflag AS tag_name, count(*) AS n FROM lineitem WHERE l_suppkey = 11 GROUP BY 1, 2")
def _(spark, d):
    tags = table(spark, d, "lineitem").selectExpr("l_orderkey AS project_id", "l_suppkey AS node_fqn", "l_returnflag AS tag_name")
    return usage.tags_of_node(tags, 11)


@query(
    "fn_report_cadence",
    """WITH c AS (SELECT c_custkey AS id, c_nationkey <> 3 AS enabled, CASE c_custkey % 3 WHEN 0 THEN 'monthly' WHEN 1 THEN 'weekly' ELSE 'off' END AS cadence,
      CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 28 + 1 ELSE c_custkey % 7 END AS day, c_custkey % 24 AS hour FROM customer),
    t AS (SELECT DISTINCT date_trunc('hour', ts) AS at_hour FROM events)
    SELECT id, CAST(at_hour AS VARCHAR) AS tick FROM c JOIN t ON enabled AND hour = extract(hour FROM at_hour)
      AND (cadence = 'monthly' AND day = extract(day FROM at_hour) OR cadence = 'weekly' AND day = extract(isodow FROM at_hour) - 1)""",
)
def _(spark, d):
    configs = table(spark, d, "customer").selectExpr(
        "c_custkey AS id", "c_nationkey <> 3 AS enabled", "CASE c_custkey % 3 WHEN 0 THEN 'monthly' WHEN 1 THEN 'weekly' ELSE 'off' END AS cadence",
        "CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 28 + 1 ELSE c_custkey % 7 END AS int) AS day", "CAST(c_custkey % 24 AS int) AS hour",
    )
    ticks = table(spark, d, "events").select(F.date_trunc("hour", "ts").alias("at")).distinct()
    return usage.due_reports(configs, ticks).select("id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("tick"))
