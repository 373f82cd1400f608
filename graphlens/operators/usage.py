"""Operational roll-ups: activity, model usage cost, billable lines, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import last_by

GRACE_DAYS = 14
EXPIRY_WARN_DAYS = 30
WARN_SHARE = 0.9
DEDUP_HOURS = 24


def since(as_of: str, days: int) -> Column:
    """``as_of`` minus some days; time is always an argument, never the clock."""
    return F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))


# --- activity ----------------------------------------------------------------------------


def activity_feed(
    log: DataFrame, users: DataFrame, as_of: str, days: int | None = None, user_id: int | None = None,
    action: str | None = None, category: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Newest activity first, with the user's name where there is one."""
    if days is not None:
        log = log.filter(F.col("created_at") >= since(as_of, days))
    if user_id is not None:
        log = log.filter(F.col("user_id") == user_id)
    if action is not None:
        log = log.filter(F.col("action") == action)
    if category is not None:
        log = log.filter(F.col("action").startswith(category + "."))
    rows = log.join(users.select(F.col("id").alias("user_id"), "user_name"), "user_id", "left")
    return rows if limit is None else rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def activity_stats(log: DataFrame, as_of: str, days: int) -> DataFrame:
    """(grouping, value, n): total, per action and per day in one aggregate."""
    recent = log.filter(F.col("created_at") >= since(as_of, days)).select("action", F.to_date("created_at").alias("day"))
    sets = recent.groupingSets([[], ["action"], ["day"]], "action", "day").agg(F.count("*").alias("n"), F.grouping_id().alias("_gid"))
    grouping = F.when(F.col("_gid") == 3, "total").when(F.col("_gid") == 1, "action").otherwise("day")
    return sets.select(grouping.alias("grouping"), F.coalesce("action", F.col("day").cast("string")).alias("value"), "n")


def unique_users(log: DataFrame, as_of: str, days: int) -> DataFrame:
    recent = log.filter((F.col("created_at") >= since(as_of, days)) & F.col("user_id").isNotNull())
    return recent.agg(F.count_distinct("user_id").alias("unique_users"))


# --- model usage -------------------------------------------------------------------------


def usage_totals(log: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, tokens and cost per ``keys``; an empty list gives the grand total."""
    aggregates = [
        F.count("*").alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("estimated_cost_usd"), F.lit(0)).cast("decimal(38,6)").alias("cost"),
    ]
    return log.groupBy(*keys).agg(*aggregates) if keys else log.agg(*aggregates)


def usage_by_project(log: DataFrame, projects: DataFrame) -> DataFrame:
    totals = usage_totals(log, ["project_id"])
    return totals.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id")


def project_usage(log: DataFrame, project_id, limit: int | None = None) -> DataFrame:
    rows = log.filter(F.col("project_id") == project_id)
    return rows if limit is None else rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


# --- billable lines ----------------------------------------------------------------------


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest completed run with a line count per project; the id breaks ties."""
    done = runs.filter((F.col("status") == "completed") & F.col("total_loc").isNotNull())
    return last_by(done, ["project_id"], ["completed_at", "id"])


def branch_loc(runs: DataFrame, projects: DataFrame) -> DataFrame:
    """(repository_id, branch, project_id, total_loc): latest lines per branch.

    Two projects of one branch overwrite each other; the larger project id stays.
    """
    branches = projects.filter("repository_id IS NOT NULL").select(
        F.col("id").alias("project_id"), "repository_id", F.coalesce("branch", F.lit("unknown")).alias("branch")
    )
    rows = latest_runs(runs).select("project_id", "total_loc").join(branches, "project_id")
    return rows.select("repository_id", "branch", "project_id", "total_loc")


def billable_loc(runs: DataFrame, projects: DataFrame, repositories: DataFrame) -> DataFrame:
    """(repository_id, billable_loc, max_loc_project_id, max_loc_branch_name, branches).

    The largest branch counts, the first project wins ties, no runs give 0. The
    per-branch breakdown stays in rows: see :func:`branch_loc`.
    """
    rows = branch_loc(runs, projects)
    best = F.max_by(F.struct("project_id", "branch"), F.struct("total_loc", -F.col("project_id")))
    totals = rows.groupBy("repository_id").agg(
        F.max("total_loc").alias("top"), best.alias("best"), F.count_distinct("branch").alias("branches")
    )
    counted = F.col("top") > 0
    return repositories.select(F.col("id").alias("repository_id")).join(totals, "repository_id", "left").select(
        "repository_id", F.greatest(F.coalesce("top", F.lit(0)), F.lit(0)).alias("billable_loc"),
        F.when(counted, F.col("best.project_id")).alias("max_loc_project_id"),
        F.when(counted, F.col("best.branch")).alias("max_loc_branch_name"), F.coalesce("branches", F.lit(0)).alias("branches"),
    )


def cumulative_loc(runs: DataFrame, projects: DataFrame, repositories: DataFrame) -> DataFrame:
    """One row: billable lines of all repositories plus standalone projects."""
    tracked = billable_loc(runs, projects, repositories).select(F.col("billable_loc").alias("loc"))
    standalone = projects.filter("repository_id IS NULL").select(F.col("id").alias("project_id"))
    alone = latest_runs(runs).join(standalone, "project_id", "left_semi").select(F.col("total_loc").alias("loc"))
    return tracked.unionByName(alone).agg(F.coalesce(F.sum("loc"), F.lit(0)).alias("cumulative_loc"))


def quota_state(expires_at: Column, loc_limit: Column, used: Column, as_of: Column) -> Column:
    """UNLICENSED, BLOCKED, GRACE, WARN or HEALTHY, the gravest first."""
    limited = loc_limit > 0
    return (
        F.when(expires_at.isNull(), "UNLICENSED")
        .when(as_of >= expires_at + F.make_dt_interval(F.lit(GRACE_DAYS)), "BLOCKED")
        .when(limited & (used >= loc_limit), "BLOCKED")
        .when(as_of >= expires_at, "GRACE")
        .when((limited & (used >= loc_limit * WARN_SHARE)) | (expires_at <= as_of + F.make_dt_interval(F.lit(EXPIRY_WARN_DAYS))), "WARN")
        .otherwise("HEALTHY")
    )


def usage_report(quotas: DataFrame, as_of: str) -> DataFrame:
    """Percent used, days left and month label of ``quotas(subject, loc_limit, expires_at, used)``."""
    now = F.lit(as_of).cast("timestamp")
    # Tenths are rounded as whole numbers: rounding the percentage at one decimal sees 112.45 as the double just below it.
    percent = F.when(F.col("loc_limit") > 0, F.round(F.col("used") / F.col("loc_limit") * 100 * 10) / 10).otherwise(F.lit(0.0))
    seconds = F.col("expires_at").cast("long") - now.cast("long")
    return quotas.select(
        "subject", percent.alias("percent"), F.coalesce(F.floor(seconds / 86400), F.lit(0)).alias("days_remaining"),
        F.date_format(now, "MMMM yyyy").alias("month"),
        quota_state(F.col("expires_at"), F.col("loc_limit"), F.col("used"), now).alias("state"),
    )


# --- repositories ------------------------------------------------------------------------


def repository_list(repositories: DataFrame, projects: DataFrame, runs: DataFrame) -> DataFrame:
    """(repository_id, created_at, billable_loc, project_id, branch, node_count, edge_count): one row per project."""
    latest = last_by(runs.filter("status = 'completed'"), ["project_id"], ["completed_at", "id"], ["node_count", "edge_count"])
    tracked = billable_loc(runs, projects, repositories).select("repository_id", "billable_loc")
    rows = projects.filter("repository_id IS NOT NULL").select(F.col("id").alias("project_id"), "repository_id", "branch")
    return (
        repositories.select(F.col("id").alias("repository_id"), "created_at").join(tracked, "repository_id")
        .join(rows, "repository_id", "left").join(latest, "project_id", "left")
        .select("repository_id", "created_at", "billable_loc", "project_id", "branch", "node_count", "edge_count")
    )


def evolution_timeline(runs: DataFrame, projects: DataFrame, repository_id, branch: str) -> DataFrame:
    wanted = projects.filter((F.col("repository_id") == repository_id) & (F.col("branch") == branch)).select(F.col("id").alias("project_id"))
    done = runs.filter("status = 'completed' AND snapshot IS NOT NULL")
    return done.join(wanted, "project_id", "left_semi").orderBy("completed_at", "id")


def pull_request_page(analyses: DataFrame, repository_id, status=None, risk=None, limit: int = 20, offset: int = 0) -> DataFrame:
    rows = analyses.filter(F.col("repository_id") == repository_id)
    if status:
        rows = rows.filter(F.col("status") == status)
    if risk:
        rows = rows.filter(F.col("risk_level") == risk)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def tags_of_node(tags: DataFrame, node) -> DataFrame:
    """(project_id, tag_name, n): tags that a node carries in each project."""
    return tags.filter(F.col("node_fqn") == node).groupBy("project_id", "tag_name").agg(F.count("*").alias("n"))


def new_tags(tags: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming tags that do not repeat (project, node, tag), neither stored nor among themselves."""
    key = ["project_id", "node_fqn", "tag_name"]
    from graphlens.functions.scale import first_by

    return first_by(incoming, key, ["id"]).join(tags.select(*key), key, "left_anti")


def chat_history(messages: DataFrame, project_id, node_fqn=None) -> DataFrame:
    rows = messages.filter(F.col("project_id") == project_id)
    if node_fqn is not None:
        rows = rows.filter(F.col("node_fqn") == node_fqn)
    return rows.orderBy("created_at", "id")


# --- report cadence ----------------------------------------------------------------------


def due_reports(configs: DataFrame, ticks: DataFrame) -> DataFrame:
    """(id, at): the hourly ticks at which each report is due.

    ``configs(id, enabled, cadence, day, hour)``: a monthly report is due on the
    ``day`` of the month, a weekly one on the ``day`` of the week (Monday is 0),
    both in the UTC ``hour``; any other cadence never. ``ticks(at)``: every tick
    of the hour counts. A tick has two keys, so this is one equi-join.
    """
    at = F.to_utc_timestamp("at", F.current_timezone())
    days = F.array(F.struct(F.lit("monthly").alias("cadence"), F.dayofmonth(at).alias("day")), F.struct(F.lit("weekly").alias("cadence"), F.weekday(at).alias("day")))
    keyed = ticks.select("at", F.hour(at).alias("hour"), F.explode(days).alias("d")).select("at", "hour", "d.cadence", "d.day")
    return configs.filter("enabled").select("id", "cadence", "day", "hour").join(keyed, ["cadence", "day", "hour"]).select("id", "at")
