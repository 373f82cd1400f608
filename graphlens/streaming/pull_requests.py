"""Pull-request events of four platforms as one stream of normal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import last_by
from graphlens.schema import literal_map

# Which deliveries count and what their actions mean.
HOST_ACTIONS = ["opened", "synchronize", "closed", "reopened"]
TEA_ACTIONS = ["opened", "synchronized", "closed", "reopened"]
MERGE_ACTIONS = {
    "open": "opened",
    "update": "updated",
    "close": "closed",
    "reopen": "reopened",
    "merge": "merged",
}
KEY_ACTIONS = {
    "pullrequest:created": "opened",
    "pullrequest:updated": "updated",
    "pullrequest:fulfilled": "merged",
    "pullrequest:rejected": "closed",
}

# JSON paths per platform for
# number, title, description, author, commit, source branch, target branch, repository.
_HUB_PATHS = [
    "$.pull_request.number", "$.pull_request.title", "$.pull_request.body", "$.pull_request.user.login",
    "$.pull_request.head.sha", "$.pull_request.head.ref", "$.pull_request.base.ref", "$.repository.html_url",
]
PATHS = {
    "github": _HUB_PATHS,
    "gitea": _HUB_PATHS,
    "gitlab": [
        "$.object_attributes.iid", "$.object_attributes.title", "$.object_attributes.description", "$.user.username",
        "$.object_attributes.last_commit.id", "$.object_attributes.source_branch", "$.object_attributes.target_branch",
        "$.project.web_url",
    ],
    "bitbucket": [
        "$.pullrequest.id", "$.pullrequest.title", "$.pullrequest.description", "$.pullrequest.author.username",
        "$.pullrequest.source.commit.hash", "$.pullrequest.source.branch.name", "$.pullrequest.destination.branch.name",
        "$.repository.links.html.href",
    ],
}
FIELDS = ["pr_number", "title", "description", "author", "commit_sha", "source_branch", "target_branch", "repo_url"]


def _at(path: str) -> Column:
    return F.get_json_object("body", path)


def _action() -> Column:
    """Canonical action, NULL for a delivery that does not matter."""
    headers, platform = F.col("headers"), F.col("platform")
    action = _at("$.action")
    merged = (action == "closed") & (_at("$.pull_request.merged") == "true")
    hub = F.when(merged, "merged").when(action.isin("synchronize", "synchronized"), "updated").otherwise(action)
    return (
        F.when(
            (platform == "github") & (headers["x-github-event"] == "pull_request") & action.isin(*HOST_ACTIONS), hub
        )
        .when((platform == "gitea") & (headers["x-gitea-event"] == "pull_request") & action.isin(*TEA_ACTIONS), hub)
        .when(
            (platform == "gitlab") & (headers["x-gitlab-event"] == "Merge Request Hook"),
            literal_map(MERGE_ACTIONS)[_at("$.object_attributes.action")],
        )
        .when(platform == "bitbucket", literal_map(KEY_ACTIONS)[headers["x-event-key"]])
    )


def parse_events(raw: DataFrame) -> DataFrame:
    """Relevant events of ``raw(platform, headers, body, received_at)``; works on streams and tables."""
    known = raw.withColumn("action", _action()).filter("action IS NOT NULL")
    columns = []
    for position, field in enumerate(FIELDS):
        value = None
        for platform, paths in PATHS.items():
            hit = F.when(F.col("platform") == platform, _at(paths[position]))
            value = hit if value is None else value.when(F.col("platform") == platform, _at(paths[position]))
        columns.append((value.cast("bigint") if field == "pr_number" else value).alias(field))
    return known.select("platform", "received_at", "action", *columns)


def monitored(events: DataFrame, config: DataFrame) -> DataFrame:
    """Events whose target branch is watched; ``config(repo_url, branches)``, an empty list watches all."""
    joined = events.join(config.select("repo_url", "repository_id", "branches"), "repo_url")
    every = F.coalesce(F.size("branches"), F.lit(0)) <= 0
    return joined.filter(every | F.array_contains("branches", F.col("target_branch"))).drop("branches")


def without_redeliveries(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per (repository, number, commit, action) inside the watermark delay."""
    return events.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(
        ["repository_id", "pr_number", "commit_sha", "action"]
    )


def analyses(deliveries: DataFrame) -> DataFrame:
    """Current analysis rows of appended deliveries: the latest delivery of a commit wins, status pending.

    Deliveries are only ever appended; the key is resolved on read, so a
    redelivery costs one row and never a rewrite of the table.
    """
    latest = last_by(deliveries, ["repository_id", "pr_number", "commit_sha"], ["received_at", "action"], ["title", "description", "target_branch"])
    return latest.withColumn("status", F.lit("pending"))
