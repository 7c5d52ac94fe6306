"""Registered queries: VCS lookups and CI step analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ci as CI
from ..operators import vcs as V
from ..sources.tables import tables
from .registry import register


@register("commit_info", """
select c.sha, c.author, c.email, c.message, c.date, coalesce(n.files_changed, 0) as files_changed, c.additions, c.deletions
from commits c left join (select sha, count(*) as files_changed from commit_files group by sha) n on c.sha = n.sha""")
def commit_info(spark, sf):
    t = tables(spark, sf)
    return V.commit_info(t.commits, t.commit_files)


@register("run_artifacts", """
select run_id, id, name, size_in_bytes as size, created_at, archive_download_url as download_url from artifacts""")
def run_artifacts(spark, sf):
    return V.run_artifacts(tables(spark, sf).artifacts)


@register("repo_stats", """
select name, full_name, stars, forks, open_issues, default_branch, language, created_at, updated_at from repos""")
def repo_stats(spark, sf):
    return V.repo_stats(tables(spark, sf).repos)


@register("pr_for_commit", """
with cand as (
  select merge_commit_sha as sha, number from pull_requests
  union all
  select pc.sha, pc.number from pr_commits pc where pc.number in (select number from pull_requests)),
best as (select sha, max(number) as number from cand group by sha)
select c.sha, b.number, p.title, p.state, p.author
from commits c left join best b on c.sha = b.sha left join pull_requests p on b.number = p.number""")
def pr_for_commit(spark, sf):
    t = tables(spark, sf)
    return V.pr_for_commit(t.commits, t.pull_requests, t.pr_commits)


LATEST_STATUS = """select deployment_id, id as status_id, state, description from (
  select *, row_number() over (partition by deployment_id order by created_at desc, id desc) as rn from deployment_statuses) s
where rn = 1"""


@register("latest_status_per_deployment", LATEST_STATUS)
def latest_status_per_deployment(spark, sf):
    return V.latest_status_per_deployment(tables(spark, sf).deployment_statuses)


@register("deployment_status", f"""
select d.id, d.environment, d.ref, d.created_at, coalesce(s.state, 'unknown') as status, s.description
from (select * from deployments order by created_at desc, id desc limit 5) d
left join ({LATEST_STATUS}) s on d.id = s.deployment_id""")
def deployment_status(spark, sf):
    t = tables(spark, sf)
    return V.deployment_status(t.deployments, t.deployment_statuses, limit=5)


RUN_ATTRS = """select r.run_id, r.id, r.repo, r.conclusion, r.created_at, l.head_sha, l.event
from pipeline_runs r join (select run_id, head_sha, event from (
  select *, row_number() over (partition by run_id order by seq desc) as rn from run_events) x where rn = 1) l on r.run_id = l.run_id"""


def _crashes(t):
    fa = t.failure_logs
    return fa.filter(F.col("error_type") == "deployment_crash").select(F.col("id").alias("log_id"), "run_id", "created_at")


@register("last_good_run", f"""
with attrs as ({RUN_ATTRS}),
good as (select repo, run_id as good_run_id, head_sha from (
  select *, row_number() over (partition by repo order by created_at desc, id desc) as rn
  from attrs where event = 'push' and conclusion = 'success') g where rn = 1)
select f.id as log_id, f.run_id, a.repo, g.head_sha is not null as success, substr(g.head_sha, 1, 7) as rollback_sha,
  case when g.head_sha is not null then 'Rolled back to commit ' || substr(g.head_sha, 1, 7)
       else 'No previous successful deployment found' end as details
from failure_logs f left join attrs a on f.run_id = a.run_id left join good g on a.repo = g.repo
where f.error_type = 'deployment_crash'""")
def last_good_run(spark, sf):
    t = tables(spark, sf)
    return V.rollback_plan(_crashes(t), V.run_attributes(t.run_events))


@register("last_good_run_asof", f"""
with attrs as ({RUN_ATTRS}),
good as (select repo, created_at, max_by(head_sha, id) as head_sha from attrs where event = 'push' and conclusion = 'success'
         group by repo, created_at),
fails as (select f.id as log_id, f.run_id, a.repo, f.created_at as failed_at
          from failure_logs f left join attrs a on f.run_id = a.run_id where f.error_type = 'deployment_crash')
select fails.log_id, fails.run_id, fails.repo, fails.failed_at, good.head_sha, substr(good.head_sha, 1, 7) as rollback_sha
from fails asof left join good on fails.repo = good.repo and fails.failed_at > good.created_at""")
def last_good_run_asof(spark, sf):
    t = tables(spark, sf)
    return V.last_good_run_asof(_crashes(t), V.run_attributes(t.run_events))


@register("test_results", """
select run_id, count(*) filter (where conclusion = 'success') as passed, count(*) filter (where conclusion = 'failure') as failed,
  count(*) filter (where conclusion = 'skipped') as skipped,
  count(*) filter (where conclusion in ('success', 'failure', 'skipped')) as total_tests
from (select run_id, case when contains(lower(step_name), 'test') then conclusion end as conclusion from steps) t group by run_id""")
def test_results(spark, sf):
    return CI.test_results(tables(spark, sf).steps)


@register("failed_test_steps", """
select run_id, step_name as name, job_name as job, seq from steps
where contains(lower(step_name), 'test') and conclusion = 'failure'""")
def failed_test_steps(spark, sf):
    return CI.failed_test_steps(tables(spark, sf).steps)


@register("flaky_tests", """
select test_name, runs, failures, failures / runs as failure_rate,
  runs >= 5 and failures / runs >= 0.2e0 and failures / runs <= 0.8e0 as is_flaky
from (select test_name, count(*) as runs, count(*) filter (where not passed) as failures from test_history group by test_name) g""")
def flaky_tests(spark, sf):
    return CI.flaky_tests(tables(spark, sf).test_history)


@register("assemble_logs", """
with jobs as (
  select run_id, job_name, min(seq) as began,
    chr(10) || '=== Job: ' || job_name || ' (Status: ' || coalesce(first(job_conclusion), 'None') || ') ===' || chr(10) || chr(10) ||
    string_agg(chr(10) || '--- Step: ' || step_name || ' ---' || chr(10) || 'Status: ' || coalesce(conclusion, 'None') ||
               case when conclusion = 'failure' then chr(10) || '✗ FAILED' else '' end, chr(10) order by step_no) as text
  from steps group by run_id, job_name)
select run_id, string_agg(text, chr(10) order by began, job_name) || chr(10) || chr(10) || 'Logs URL: https://example.com/runs/' || run_id || '/logs' as logs
from jobs group by run_id""")
def assemble_logs(spark, sf):
    return CI.assemble_logs(tables(spark, sf).steps)


@register("nested_steps_roundtrip", """
select run_id, job_name, job_conclusion, step_no, step_name, conclusion from steps""")
def nested_steps_roundtrip(spark, sf):
    return CI.flatten_jobs(CI.nest_steps(tables(spark, sf).steps))
