"""Version-control lookups as joins over commit / PR / deployment / run tables.

"First in list order" of the API (newest first) becomes an explicit order on number / time /
id, chosen with ``max_by`` aggregates (map-side combined) rather than windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import running, written


def commit_info(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Commit attributes with the number of changed files."""
    n = commit_files.groupBy("sha").agg(F.count(F.lit(1)).alias("files_changed"))
    return commits.join(n, "sha", "left").select(
        "sha", "author", "email", "message", "date",
        F.coalesce("files_changed", F.lit(0)).alias("files_changed"), "additions", "deletions")


def run_artifacts(artifacts: DataFrame) -> DataFrame:
    """One row per artifact of a run."""
    return artifacts.select("run_id", "id", "name", F.col("size_in_bytes").alias("size"), "created_at",
                            F.col("archive_download_url").alias("download_url"))


def repo_stats(repos: DataFrame) -> DataFrame:
    """Repository attribute rows."""
    return repos.select("name", "full_name", "stars", "forks", "open_issues", "default_branch", "language",
                        "created_at", "updated_at")


def pr_for_commit(commits: DataFrame, pull_requests: DataFrame, pr_commits: DataFrame) -> DataFrame:
    """Per commit, the newest PR merged as that commit or containing it; null when none.

    ``merge sha = s OR s in commits(pr)`` is two equi-joins unioned (an OR condition would be a
    nested-loop join), then the newest candidate per sha is an aggregate.
    """
    prs = pull_requests.select("number", "merge_commit_sha")
    by_merge = prs.select(F.col("merge_commit_sha").alias("sha"), "number")
    by_member = pr_commits.join(prs.select("number"), "number", "left_semi").select("sha", "number")
    cand = by_merge.unionByName(by_member).join(commits.select("sha"), "sha", "left_semi")
    best = cand.groupBy("sha").agg(F.max("number").alias("number"))
    j = commits.select("sha").join(best, "sha", "left").join(
        pull_requests.select("number", "title", "state", "author"), "number", "left")
    return j.select("sha", "number", "title", "state", "author")


def latest_status_per_deployment(statuses: DataFrame) -> DataFrame:
    """Newest status of each deployment (created_at desc, id desc)."""
    g = statuses.groupBy("deployment_id").agg(
        F.max_by(F.struct("id", "state", "description"), F.struct("created_at", "id")).alias("s"))
    return g.select("deployment_id", F.col("s.id").alias("status_id"), F.col("s.state").alias("state"),
                    F.col("s.description").alias("description"))


def deployment_status(deployments: DataFrame, statuses: DataFrame, limit: int = 5) -> DataFrame:
    """The ``limit`` newest deployments with their newest status (``unknown`` when none)."""
    top = deployments.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    st = statuses.select("deployment_id", F.struct(F.col("created_at").alias("at"), F.col("id").alias("status_id"), "state", "description").alias("s"))
    j = top.join(st, top["id"] == st["deployment_id"], "left").groupBy("id", "environment", "ref", "created_at").agg(F.max("s").alias("s"))
    return j.select("id", "environment", "ref", "created_at", F.coalesce("s.state", F.lit("unknown")).alias("status"), "s.description")


def run_attributes(run_events: DataFrame) -> DataFrame:
    """Per run, in one aggregate over its events: repo and creation time from the first event
    (as the upsert keeps them), conclusion, commit, trigger event and author from the latest one."""
    g = run_events.groupBy("run_id").agg(
        F.min_by(F.struct("repo", "ts"), F.col("seq")).alias("f"),
        F.max_by(F.struct("conclusion", "head_sha", "event", "author"), F.col("seq")).alias("l"))
    return g.select("run_id", F.col("run_id").try_cast("bigint").alias("id"), F.col("f.repo").alias("repo"),
                    F.col("l.conclusion").alias("conclusion"), F.col("f.ts").alias("created_at"),
                    F.col("l.head_sha").alias("head_sha"), F.col("l.event").alias("event"),
                    F.col("l.author").alias("author"))


def good_runs(attrs: DataFrame) -> DataFrame:
    return attrs.filter((F.col("event") == "push") & (F.col("conclusion") == "success"))


def last_good_run(attrs: DataFrame) -> DataFrame:
    """J6 building block: per repo the newest successful push run and its commit."""
    g = good_runs(attrs).groupBy("repo").agg(
        F.max_by(F.struct("run_id", "head_sha"), F.struct("created_at", "id")).alias("g"))
    return g.select("repo", F.col("g.run_id").alias("good_run_id"), F.col("g.head_sha").alias("head_sha"))


def rollback_plan(crashes: DataFrame, attrs: DataFrame) -> DataFrame:
    """For each crash (rows with ``run_id``), roll back to the repo's newest good commit. A crash
    whose run is unknown has no repo and finds none."""
    c = crashes.join(attrs.select("run_id", "repo"), "run_id", "left")
    j = c.join(last_good_run(attrs), "repo", "left")
    sha7 = F.substring("head_sha", 1, 7)
    return j.select(
        "log_id", "run_id", "repo", F.col("head_sha").isNotNull().alias("success"), sha7.alias("rollback_sha"),
        F.when(F.col("head_sha").isNotNull(), F.concat(F.lit("Rolled back to commit "), sha7))
         .otherwise(F.lit("No previous successful deployment found")).alias("details"))


def last_good_run_asof(failures: DataFrame, attrs: DataFrame, parts: int | None = None) -> DataFrame:
    """For each failure (``log_id, run_id, created_at``) the newest good run of its repo
    created strictly before the failure. An as-of join: both sides in one ordered sequence per
    repo (good runs sort after failures at equal time, so "before" is strict), carrying the last
    good sha forward, dealt out by rows so a repo or an hour with most of them is split across tasks. Of good runs at
    one instant the one with the largest id counts. A failure whose run is unknown, or without a time, has no commit.
    """
    f = failures.join(attrs.select("run_id", "repo"), "run_id", "left").select(
        "repo", "log_id", "run_id", F.col("created_at").alias("t"), F.lit(0).alias("good"), F.lit(None).cast("string").alias("sha"))
    g = good_runs(attrs).filter(F.col("repo").isNotNull() & F.col("created_at").isNotNull()).groupBy("repo", "created_at") \
        .agg(F.max_by("head_sha", F.struct("id", "run_id")).alias("sha"))
    g = g.select("repo", F.lit(None).cast("bigint").alias("log_id"), F.lit(None).cast("string").alias("run_id"),
                 F.col("created_at").alias("t"), F.lit(1).alias("good"), "sha")
    carried = running(written(f.unionByName(g), "asof"), ["repo"], ["t", "good", "log_id"], last={"good_sha": F.col("sha")}, parts=parts)
    r = carried.filter("good = 0")
    return r.select("log_id", "run_id", "repo", F.col("t").alias("failed_at"), F.col("good_sha").alias("head_sha"),
                    F.substring("good_sha", 1, 7).alias("rollback_sha"))
