"""Derived input views over the driver's ``events`` table (see FIXTURES.md section 3).

Each view is plain SQL text that runs unchanged in Spark SQL and in DuckDB, so the
same shapes feed both the Spark operators and the DuckDB oracles. Views are listed in
dependency order. ``as_of`` values are parameters of the operators, never ``now()``.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}

VIEWS["run_events"] = """
select event_id as seq, cast(cast(floor(event_id / 4) as bigint) as string) as run_id, ts,
  case event_id % 4 when 0 then 'requested' when 1 then 'in_progress' else 'completed' end as action,
  case event_id % 4 when 0 then 'queued' when 1 then 'in_progress' else 'completed' end as status,
  case when event_id % 4 < 2 then null when event_type = 'error' then 'failure'
       when event_type = 'view' then 'cancelled' else 'success' end as conclusion,
  'org/repo-' || cast(user_id % 20 as string) as repo, 'dev-' || cast(user_id as string) as author,
  case when user_id % 4 = 0 then 'pull_request' else 'push' end as event,
  case when user_id % 3 = 0 then 'main' else 'feature-' || cast(user_id % 7 as string) end as head_branch,
  md5(cast(event_id as string)) as head_sha, value
from events
where not (cast(floor(event_id / 4) as bigint) % 13 = 0 and event_id % 4 >= 2)
"""

VIEWS["pipeline_runs"] = """
select cast(l.run_id as bigint) as id, l.run_id, f.repo, l.status, l.conclusion, f.ts as started_at,
  case when l.status = 'completed' then l.ts end as completed_at, f.ts as created_at
from (select *, row_number() over (partition by run_id order by seq desc) as rn from run_events) l
join (select *, row_number() over (partition by run_id order by seq) as rn from run_events) f
  on l.run_id = f.run_id and l.rn = 1 and f.rn = 1
"""

VIEWS["job_logs"] = """
select seq as log_id, run_id, ts as created_at, case seq % 17
  when 0 then 'Traceback (most recent call last):' || chr(10) || '  File "app.py", line 3' || chr(10) || 'ModuleNotFoundError: No module named ''pkg' || cast(seq % 9 as string) || '''' || chr(10) || chr(10) || 'Process exited'
  when 1 then 'ImportError: cannot import name ''util' || cast(seq % 5 as string) || ''''
  when 2 then 'ERROR: Could not find a version that satisfies the requirement lib' || cast(seq % 6 as string) || '==9.9.9'
  when 3 then 'FAILED tests/test_slow.py::test_case' || cast(seq % 11 as string) || ' - Timeout' || chr(10) || 'Test exceeded 60s timeout'
  when 4 then 'FAILED tests/test_api.py::test_user' || cast(seq % 8 as string) || chr(10) || 'AssertionError: Expected 200 but got 404'
  when 5 then 'Build step compile failed with exit code ' || cast(1 + seq % 3 as string)
  when 6 then 'Error: Command failed: npm install'
  when 7 then 'Error: Deployment app-' || cast(seq % 4 as string) || ' crashed' || chr(10) || 'CrashLoopBackOff'
  when 8 then 'OOMKilled: Container exceeded memory limit (512Mi)'
  when 9 then 'ERROR: Connection timeout when connecting to registry'
  when 10 then 'SyntaxError: invalid syntax'
  when 11 then 'PermissionError: [Errno 13] Permission denied'
  when 12 then 'KeyError: ''cfg' || cast(seq % 3 as string) || ''''
  when 13 then 'assertionerror: lower case still matches'
  when 14 then 'NO LOGS' when 15 then '' else 'all good' end as logs
from (select seq, ts, conclusion, case when seq % 23 = 5 then 'gone-' || run_id else run_id end as run_id from run_events) r where conclusion = 'failure'
"""

VIEWS["healing_actions"] = """
select seq as id, run_id, case seq % 4 when 0 then 'missing_dependency' when 1 then 'test_timeout' when 2 then 'build_failure' else 'network_timeout' end as action_type,
  value < case seq % 4 when 3 then 1000 when 2 then 90 else 30 end as success, '{"seq": ' || cast(seq as string) || '}' as details, ts as created_at
from (select seq, ts, value, conclusion, case when seq % 31 = 5 then 'gone-' || run_id else run_id end as run_id from run_events) r
where conclusion = 'failure' and seq % 3 <> 0
"""

VIEWS["metrics"] = """
select event_id as id, cast(cast(floor(event_id / 4) as bigint) as string) as run_id, event_type as metric_name, value as metric_value, ts as timestamp from events
"""

VIEWS["steps"] = """
select seq, run_id, job_name, step_no, step_name, conclusion,
  case when max(case when conclusion = 'failure' then 1 else 0 end) over (partition by run_id, job_name) = 1 then 'failure' else 'success' end as job_conclusion, started_at
from (select event_id as seq, cast(cast(floor(event_id / 20) as bigint) as string) as run_id,
    'job-' || cast(cast(floor(event_id % 20 / 5) as bigint) * 7 % 10 + 4 as string) as job_name, event_id % 5 as step_no,
    case event_id % 5 when 0 then 'Run unit Tests' when 1 then 'build' when 2 then 'pytest' when 3 then 'deploy' else 'integration TEST' end as step_name,
    case event_id % 7 when 0 then 'failure' when 1 then 'skipped' when 2 then 'cancelled' when 3 then null else 'success' end as conclusion, ts as started_at
  from events) s
"""

VIEWS["pull_requests"] = """
select cast(floor(event_id / 10) as bigint) as number, 'PR ' || cast(cast(floor(event_id / 10) as bigint) as string) as title,
  case when event_type = 'error' then 'open' else 'closed' end as state, 'dev-' || cast(user_id as string) as author,
  md5(cast(event_id as string)) as merge_commit_sha
from events where event_id % 10 = 9
"""

VIEWS["pr_commits"] = """
select cast(floor(event_id / 10) as bigint) as number, md5(cast(event_id as string)) as sha from events where event_id % 10 < 7
"""

VIEWS["deployments"] = """
select cast(floor(event_id / 6) as bigint) as id, case when user_id % 2 = 0 then 'production' else 'staging' end as environment,
  'ref-' || cast(event_id as string) as ref, ts as created_at
from events where event_id % 6 = 0
"""

VIEWS["deployment_statuses"] = """
select event_id as id, cast(floor(event_id / 6) as bigint) as deployment_id,
  case event_type when 'error' then 'failure' when 'view' then 'pending' else 'success' end as state,
  case when event_type = 'signup' then null else 'by ' || event_type end as description, ts as created_at
from events where event_id % 6 in (1, 2, 3) and cast(floor(event_id / 6) as bigint) % 5 <> 0
"""

VIEWS["repo_files"] = """
select 'org/repo-' || cast(r as string) as repo, 'main' as branch, path,
  case when path = 'requirements.txt' then 'requests==2.31.0' || chr(10) || 'pkg' || cast(r % 9 as string) || chr(10)
       when path = 'pytest.ini' then case when r % 2 = 0 then '[pytest]' || chr(10) || 'timeout = 60' || chr(10) else '[pytest]' || chr(10) end
       else case when r % 3 = 0 then 'jobs:' || chr(10) || '  timeout-minutes: 10' || chr(10) else 'jobs: {}' || chr(10) end end as content
from (select distinct user_id % 20 as r from events) a
cross join (select 'requirements.txt' as path union all select 'pytest.ini' union all select '.github/workflows/main.yml') b
where not (path = 'pytest.ini' and r % 5 = 4)
"""

VIEWS["advisories"] = """
select distinct 'pkg' || cast(user_id % 9 as string) as package, case when user_id % 9 in (2, 5) then null else '2.0.' || cast(user_id % 9 as string) end as safe_version
from events where user_id % 9 <> 7
"""

VIEWS["test_history"] = """
select event_id as seq, 'test_' || cast(user_id % 40 as string) as test_name, ts,
  not (event_type = 'error' or (user_id % 40 < 10 and event_type = 'view') or user_id % 40 = 39) as passed
from events
"""

VIEWS["run_features"] = """
select event_id as id, run_id, ts as created_at, value * 10 as build_duration_avg, event_id % 190 + 10 as test_count, event_id % 49 + 1 as changed_files,
  event_id * 7 % 990 + 10 as commit_size, event_id * 3 % 10 as previous_failures, event_id * 11 % 5 as dependency_changes,
  event_id * 13 % 29 + 1 as code_complexity, event_id * 17 % 60 + 40 as test_coverage, (event_id * 19 % 500) / 1000e0 as author_failure_rate,
  event_id * 23 % 365 as branch_age_days
from (select *, cast(cast(floor(event_id / 4) as bigint) as string) as run_id from events) e
"""

VIEWS["predictions"] = """
select seq as id, case when conclusion = 'failure' then 1 else 0 end as label, case when value > 25 then 1 else 0 end as prediction
from run_events where conclusion is not null
"""

VIEWS["counter_samples"] = """
select event_id as seq, ts, event_type as job, 'host-' || cast(user_id % 4 as string) || ':9100' as address,
  cast(count(*) over (partition by event_type, user_id % 4, cast(ts as date) order by event_id rows between unbounded preceding and current row) as double) as value
from events
"""

VIEWS["bucket_samples"] = """
select event_id as seq, ts, event_type as job, b.le, cast(sum(case when value <= b.le then 1 else 0 end) over (partition by event_type, b.le, cast(ts as date) order by event_id
  rows between unbounded preceding and current row) as double) as value
from events cross join (select 5e0 as le union all select 10e0 union all select 25e0 union all select 50e0 union all select 100e0
  union all select 250e0 union all select cast('Infinity' as double)) b
"""

VIEWS["duration_buckets"] = """
select cast(m.timestamp as date) as day, b.le, cast(count(case when m.metric_value <= b.le then 1 end) as double) as cum_count
from metrics m cross join (select 5e0 as le union all select 10e0 union all select 25e0 union all select 50e0 union all select 100e0
  union all select 250e0 union all select cast('Infinity' as double)) b
group by 1, 2
"""

VIEWS["webhooks"] = """
select event_id as delivery_id, ts, case event_id % 5 when 0 then 'push' when 1 then 'pull_request' when 2 then 'issues' else 'workflow_run' end as event_type,
  '{"action":"' || case event_id % 4 when 0 then 'requested' when 1 then 'failed' else 'completed' end || '","ref":"refs/heads/main","workflow_run":{"id":' || cast(event_id as string)
  || ',"status":"completed"' || case event_id % 6 when 0 then ',"created_at":"2024-01-05T10:00:00Z","updated_at":"2024-01-05 10:05:00"'
    when 1 then ',"created_at":"2024-01-05T10:00:00+02:00","updated_at":"garbage"' when 2 then ',"created_at":null'
    when 3 then ',"created_at":"2024-13-45T99:00:00Z","updated_at":"2024-01-05T10:05:00-03:30"' else '' end || ',"conclusion":"' || case when event_type = 'error' then 'failure' else 'success' end || '"},"repository":{"full_name":"org/repo-' || cast(user_id % 20 as string) || '"}}' as payload
from events
"""

VIEWS["run_deliveries"] = """
select event_id as delivery_id, ts, 'workflow_run' as event_type, case when event_id % 97 = 5 then 'not json' else
  '{"action":"' || case event_id % 5 when 0 then 'requested' when 1 then 'failed' else 'completed' end || '","workflow_run":{"id":' || cast(cast(floor(event_id / 3) as bigint) as string)
  || ',"status":"' || case event_id % 3 when 0 then 'in_progress' else 'completed' end || '","created_at":"2024-01-05T10:00:0' || cast(event_id % 10 as string) || 'Z","updated_at":'
  || case when event_id % 4 = 0 then 'null' else '"2024-01-05T10:05:00+0' || cast(event_id % 3 as string) || ':00"' end || ',"conclusion":'
  || case when event_id % 3 = 0 then 'null' when event_type = 'error' then '"failure"' else '"success"' end || '},"repository":{"full_name":"org/repo-' || cast(user_id % 20 as string) || '"}}' end as payload
from events
"""

VIEWS["polled_runs"] = """
select event_id as seq, cast(floor(event_id / 4) as bigint) as id, case when event_id % 6 = 0 then null else 'ci-' || event_type end as name,
  case when event_id % 8 = 1 then null else 'completed' end as status, case when event_id % 4 < 2 then null when event_type = 'error' then 'failure' else 'success' end as conclusion,
  case when event_id % 50 = 0 then null else ts end as created_at, case when event_id % 3 = 0 then null else event_id % 4 end as run_attempt,
  case when event_id % 5 = 0 then null else event_id % 12 end as run_number, case when event_id % 7 = 0 then null else event_id % 60 + 40 end as test_coverage,
  case when event_id % 9 = 0 then null else event_id % 49 end as changed_files, case when event_id % 4 = 1 then null else event_id % 5 end as dependency_changes,
  case when event_id % 10 = 3 then null else event_id % 30 end as code_complexity, case when event_id % 11 = 2 then null else event_id % 190 end as test_count
from events
"""

VIEWS["poll_responses"] = """
select event_id as poll_id, ts, case event_id % 7 when 0 then '{}' when 1 then '[]' when 2 then '{"workflow_runs":5}' when 3 then 'not json'
  when 4 then '{"workflow_runs":' || case event_id % 5 when 0 then '[]' when 1 then '0' when 2 then '""' when 3 then '{}' else '7' end || '}' else '{"workflow_runs":[{"id":' || cast(event_id as string) || ',"name":"ci","status":"completed","conclusion":"success"},{"name":"no id"},{"id":'
  || cast(event_id + 1 as string) || ',"status":"in_progress","conclusion":null}]}' end as raw
from events
"""

VIEWS["commits"] = """
select md5(cast(event_id as string)) as sha, 'dev-' || cast(user_id as string) as author, 'dev-' || cast(user_id as string) || '@example.com' as email,
  'change ' || event_type as message, ts as date, event_id % 300 as additions, event_id % 120 as deletions from events
"""

VIEWS["commit_files"] = """
select md5(cast(event_id as string)) as sha, 'src/f' || cast(k as string) || '.py' as path
from events cross join (select 0 as k union all select 1 union all select 2 union all select 3) x where k < event_id % 5
"""

VIEWS["artifacts"] = """
select event_id as id, cast(cast(floor(event_id / 4) as bigint) as string) as run_id, 'artifact-' || event_type as name, event_id * 1024 as size_in_bytes, ts as created_at,
  'https://example.com/a/' || cast(event_id as string) as archive_download_url from events where event_id % 3 = 0
"""

VIEWS["repos"] = """
select 'repo-' || cast(user_id % 20 as string) as name, 'org/repo-' || cast(user_id % 20 as string) as full_name, count(*) as stars, count(distinct user_id) as forks,
  count(case when event_type = 'error' then 1 end) as open_issues, 'main' as default_branch, 'Python' as language, min(ts) as created_at, max(ts) as updated_at
from events group by user_id % 20
"""
