"""Streaming jobs run over the tables as streams until all their rows are processed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphlens.functions import text
from graphlens.functions.scale import shared_dir
from graphlens.plans.registry import query, table
from graphlens.streaming import pull_requests, rollups


def stream(spark, d, name):
    return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _fresh(spark):
    return f"{shared_dir(spark)}/graphlens/stream-{uuid.uuid4().hex}"


PLATFORM = "CASE o_orderpriority WHEN '1-URGENT' THEN 'github' WHEN '2-HIGH' THEN 'gitlab' WHEN '3-MEDIUM' THEN 'bitbucket' ELSE 'gitea' END"
HEADER = """CASE o_orderpriority WHEN '1-URGENT' THEN map('x-github-event', CASE WHEN o_orderstatus = 'P' THEN 'push' ELSE 'pull_request' END)
  WHEN '2-HIGH' THEN map('x-gitlab-event', 'Merge Request Hook')
  WHEN '3-MEDIUM' THEN map('x-event-key', CASE o_orderstatus WHEN 'F' THEN 'pullrequest:fulfilled' WHEN 'O' THEN 'pullrequest:created' ELSE 'repo:push' END)
  ELSE map('x-gitea-event', 'pull_request') END"""
HUB_BODY = """concat('{"action": "', CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'synchronize' ELSE 'synchronized' END ELSE 'labeled' END,
  '", "repository": {"html_url": "r', o_custkey % 50, '"}, "pull_request": {"number": ', o_custkey, ', "title": "t', o_orderkey, '", "merged": ', CASE WHEN o_totalprice > 250000 THEN 'true' ELSE 'false' END,
  ', "user": {"login": "u"}, "head": {"sha": "s', o_custkey % 7, '", "ref": "f"}, "base": {"ref": "b', o_custkey % 3, '"}}}')"""
LAB_BODY = """concat('{"object_attributes": {"action": "', CASE o_orderstatus WHEN 'F' THEN 'merge' WHEN 'O' THEN 'update' ELSE 'approved' END, '", "iid": ', o_custkey, ', "title": "t', o_orderkey,
  '", "last_commit": {"id": "s', o_custkey % 7, '"}, "source_branch": "f", "target_branch": "b', o_custkey % 3, '"}, "user": {"username": "u"}, "project": {"web_url": "r', o_custkey % 50, '"}}')"""
BUCKET_BODY = """concat('{"pullrequest": {"id": ', o_custkey, ', "title": "t', o_orderkey, '", "author": {"username": "u"}, "source": {"commit": {"hash": "s', o_custkey % 7,
  '"}, "branch": {"name": "f"}}, "destination": {"branch": {"name": "b', o_custkey % 3, '"}}}, "repository": {"links": {"html": {"href": "r', o_custkey % 50, '"}}}}')"""


def deliveries(orders):
    body = f"CASE o_orderpriority WHEN '2-HIGH' THEN {LAB_BODY} WHEN '3-MEDIUM' THEN {BUCKET_BODY} ELSE {HUB_BODY} END"
    return orders.selectExpr(
        f"{PLATFORM} AS platform", f"{HEADER} AS headers", f"{body} AS body", "CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(0, 0, 0, o_orderkey % 86400) AS received_at"
    )


def watched(spark, d):
    return table(spark, d, "customer").selectExpr("concat('r', c_custkey % 50) AS repo_url", "c_custkey % 50 AS repository_id").distinct().selectExpr(
        "repo_url", "repository_id", "CASE WHEN repository_id % 2 = 0 THEN array() ELSE array('b0', 'b1') END AS branches"
    )


EVENTS = """ev AS (SELECT o_custkey % 50 AS repository_id, o_custkey AS pr_number, 's' || (o_custkey % 7) AS commit_sha, 't' || o_orderkey AS title, 'b' || (o_custkey % 3) AS target_branch,
    o_orderdate + INTERVAL 1 SECOND * (o_orderkey % 86400) AS received_at,
    CASE o_orderpriority WHEN '2-HIGH' THEN CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'updated' END
      WHEN '3-MEDIUM' THEN CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'opened' END
      ELSE CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_totalprice > 250000 THEN 'merged' ELSE 'closed' END WHEN 'O' THEN 'updated' END END AS action FROM orders),
  seen AS (SELECT * FROM ev WHERE action IS NOT NULL AND (repository_id % 2 = 0 OR target_branch IN ('b0', 'b1')))"""


@query("str1_pull_request_intake", f"WITH {EVENTS} SELECT repository_id, pr_number, commit_sha, title, target_branch, action FROM seen")
def _(spark, d):
    events = pull_requests.parse_events(deliveries(stream(spark, d, "orders")))
    rows = rollups.run_available(pull_requests.monitored(events, watched(spark, d)), _fresh(spark))
    return rows.select("repository_id", "pr_number", "commit_sha", "title", "target_branch", "action")


@query(
    "str2_redelivery_upsert",
    f"WITH {EVENTS} SELECT repository_id, pr_number, commit_sha, max_by(title, struct_pack(r := received_at, a := action)) AS title, 'pending' AS status FROM seen GROUP BY 1, 2, 3",
)
def _(spark, d):
    events = pull_requests.parse_events(deliveries(stream(spark, d, "orders")))
    rows = rollups.run_available(pull_requests.monitored(events, watched(spark, d)), _fresh(spark))
    return pull_requests.analyses(rows).select("repository_id", "pr_number", "commit_sha", "title", "status")


@query("str2_without_redeliveries", f"WITH {EVENTS} SELECT DISTINCT repository_id, pr_number, commit_sha, action FROM seen")
def _(spark, d):
    events = pull_requests.monitored(pull_requests.parse_events(deliveries(stream(spark, d, "orders"))), watched(spark, d))
    rows = rollups.run_available(pull_requests.without_redeliveries(events), _fresh(spark))
    return rows.select("repository_id", "pr_number", "commit_sha", "action")


def _log(events):
    return events.selectExpr("CAST(ts AS TIMESTAMP) AS created_at", "event_type AS action", "user_id", "value")


@query("str3_activity_per_day", "SELECT CAST(ts AS DATE) AS day, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    rows = rollups.run_available(rollups.activity_per_day(_log(stream(spark, d, "events"))), _fresh(spark), "update")
    return rollups.latest(rows, ["day", "action"])


@query(
    "str4_usage_per_day",
    """SELECT CAST(ts AS DATE) AS day, event_type AS source, count(*) AS calls, CAST(sum(event_id % 1000) AS BIGINT) AS input_tokens, CAST(sum(user_id) AS BIGINT) AS output_tokens,
      CAST(sum(event_id % 1000 * 3 + user_id * 15) AS DOUBLE) / 1000000 AS cost FROM events GROUP BY 1, 2""",
)
def _(spark, d):
    log = stream(spark, d, "events").selectExpr("CAST(ts AS TIMESTAMP) AS created_at", "event_type AS source", "event_id % 1000 AS input_tokens", "user_id AS output_tokens")
    log = log.withColumn("estimated_cost_usd", text.usage_cost(F.col("input_tokens"), F.col("output_tokens"), "3.0", "15.0"))
    rows = rollups.run_available(rollups.usage_per_day(log), _fresh(spark), "update")
    return rollups.latest(rows, ["day", "source"]).withColumn("cost", F.col("cost").cast("double"))


SENT = """WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT user_id AS subject, event_type AS trigger, ts FROM events),
    s(subject, trigger, sent_at) AS (SELECT subject, trigger, min(ts) FROM e GROUP BY 1, 2
      UNION ALL SELECT x.subject, x.trigger, x.nxt FROM (SELECT s.subject, s.trigger, min(e.ts) AS nxt FROM s JOIN e ON e.subject = s.subject AND e.trigger = s.trigger
        AND e.ts > s.sent_at + INTERVAL 24 HOUR GROUP BY s.subject, s.trigger, s.sent_at) x)
    SELECT subject, trigger, count(*) AS sent, min(epoch_us(sent_at)) AS first_us, max(epoch_us(sent_at)) AS last_us FROM s GROUP BY 1, 2"""


def _sent(accepted):
    return accepted.groupBy("subject", "trigger").agg(
        F.count("*").alias("sent"), F.min(F.unix_micros("sent_at")).alias("first_us"), F.max(F.unix_micros("sent_at")).alias("last_us")
    )


@query("str5_notification_suppression", SENT)
def _(spark, d):
    events = table(spark, d, "events").selectExpr("user_id AS subject", "event_type AS trigger", "CAST(ts AS TIMESTAMP) AS sent_at")
    return _sent(rollups.suppress_batch(events))


@query("str5_suppression_stream", SENT)
def _(spark, d):
    events = stream(spark, d, "events").selectExpr("user_id AS subject", "event_type AS trigger", "CAST(ts AS TIMESTAMP) AS sent_at")
    return _sent(rollups.run_available(rollups.suppress_stream(events), _fresh(spark)))


@query(
    "str6_run_progress",
    "SELECT user_id AS run_id, max_by(event_type, struct_pack(a := ts, b := event_type)) AS stage FROM events GROUP BY 1",
)
def _(spark, d):
    events = stream(spark, d, "events").selectExpr("user_id AS run_id", "CAST(ts AS TIMESTAMP) AS at", "event_type AS stage", "CASE WHEN value > 10 THEN 'failed' ELSE 'ok' END AS status")
    rows = rollups.run_available(rollups.run_progress(events), _fresh(spark), "update")
    return rollups.latest(rows, ["run_id"]).select("run_id", "stage")
