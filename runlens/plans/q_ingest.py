"""Registered queries: webhook and poll ingest, append sinks, observed runs (S1, S2, S4, S6-S8, 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify_ops as K
from ..sources import ingest as I
from ..sources.tables import tables
from .q_runs import AS_OF
from .registry import register

J = "json_extract_string(payload, '{}')"


def _utc(path: str) -> str:
    """The text at ``path`` as UTC: its offset, if it has one, is taken off (a plain cast ignores it)."""
    x = J.format(path)
    part = lambda i: f"regexp_extract({x}, '([+-])([0-9]{{2}}):?([0-9]{{2}})$', {i})"
    minutes = f"coalesce(try_cast({part(1)} || (try_cast({part(2)} as int) * 60 + try_cast({part(3)} as int)) as int), 0)"
    return f"(try_cast(regexp_replace({x}, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$', '') as timestamp) - to_minutes({minutes}))"


@register("webhook_ingest", f"""
select delivery_id, {J.format('$.action')} as action,
  case when {J.format('$.action')} in ('completed', 'failed') then 'received' else 'ignored' end as outcome,
  case when {J.format('$.action')} in ('completed', 'failed') then {J.format('$.workflow_run.id')} end as run_id,
  case when {J.format('$.action')} in ('completed', 'failed') then {J.format('$.repository.full_name')} end as repo,
  case when {J.format('$.action')} in ('completed', 'failed') then {J.format('$.workflow_run.status')} end as status,
  case when {J.format('$.action')} in ('completed', 'failed') then {J.format('$.workflow_run.conclusion')} end as conclusion,
  case when {J.format('$.action')} in ('completed', 'failed') then {_utc('$.workflow_run.created_at')} end as started_at,
  case when {J.format('$.action')} in ('completed', 'failed') then {_utc('$.workflow_run.updated_at')} end as completed_at
from webhooks""")
def webhook_ingest(spark, sf):
    return I.webhook_ingest(tables(spark, sf).webhooks)


JX = "cast(json_extract(payload, '{}') as varchar)"


@register("webhook_route", f"""
select delivery_id, event_type as event,
  case when event_type in ('workflow_run', 'pull_request') then {J.format('$.action')} end as action,
  case when event_type = 'workflow_run' then {JX.format('$.workflow_run')} end as workflow_run,
  case when event_type = 'pull_request' then {JX.format('$.pull_request')} end as pull_request,
  case when event_type = 'push' then {J.format('$.ref')} end as ref,
  case when event_type = 'push' then {JX.format('$.commits')} end as commits,
  case when event_type = 'push' then {JX.format('$.pusher')} end as pusher,
  case when event_type in ('workflow_run', 'push', 'pull_request') then {JX.format('$.repository')} end as repository,
  case when event_type not in ('workflow_run', 'push', 'pull_request') then payload end as payload
from webhooks""")
def webhook_route(spark, sf):
    return I.webhook_route(tables(spark, sf).webhooks)


POLL_OK = """select poll_id, raw from poll_responses
  where json_valid(raw) and json_type(raw) = 'OBJECT' and json_type(raw, '$.workflow_runs') = 'ARRAY'"""
POLL_RUNS = f"""select poll_id, cast(i - 1 as integer) as idx, r from (
  select poll_id, unnest(cast(json_extract(raw, '$.workflow_runs') as json[])) as r,
         unnest(range(1, cast(json_array_length(raw, '$.workflow_runs') as bigint) + 1)) as i from ({POLL_OK}) o) x"""


@register("poll_ingest", f"""
select poll_id, idx, cast(json_extract(r, '$.id') as bigint) as id, json_extract_string(r, '$.name') as name,
  json_extract_string(r, '$.status') as status, json_extract_string(r, '$.conclusion') as conclusion
from ({POLL_RUNS}) x where json_type(r) = 'OBJECT' and json_extract(r, '$.id') is not null and json_type(r, '$.id') <> 'NULL'""")
def poll_ingest(spark, sf):
    return I.poll_ingest(tables(spark, sf).poll_responses)


@register("poll_ingest_drop_falsy", f"""
select poll_id, idx, cast(json_extract(r, '$.id') as bigint) as id, json_extract_string(r, '$.name') as name,
  json_extract_string(r, '$.status') as status, json_extract_string(r, '$.conclusion') as conclusion
from ({POLL_RUNS}) x where json_type(r) = 'OBJECT' and json_extract(r, '$.id') is not null and json_type(r, '$.id') <> 'NULL'
  and cast(json_extract(r, '$.id') as bigint) <> 0""")
def poll_ingest_drop_falsy(spark, sf):
    return I.poll_ingest(tables(spark, sf).poll_responses, drop_falsy_ids=True)


@register("poll_ingest_summary", f"""
select (select count(*) from poll_responses) as responses,
  (select count(*) from poll_responses) - (select count(*) from ({POLL_OK}) o) - (select count(*) from poll_responses
    where case when json_valid(raw) then json_type(raw) = 'OBJECT' and (coalesce(json_type(raw, '$.workflow_runs'), 'NULL') = 'NULL'
      or json_extract(raw, '$.workflow_runs')::varchar in ('0', '""', '{{}}', 'false')) else false end)
    as malformed_responses,
  (select count(*) from ({POLL_RUNS}) x where json_type(r) = 'OBJECT' and json_type(r, '$.id') is not null and json_type(r, '$.id') <> 'NULL') as runs_kept,
  (select count(*) from ({POLL_RUNS}) x where not (json_type(r) = 'OBJECT' and json_type(r, '$.id') is not null and json_type(r, '$.id') <> 'NULL')) as runs_dropped""")
def poll_ingest_summary(spark, sf):
    return I.poll_ingest_summary(tables(spark, sf).poll_responses)


@register("observed_runs", """
select distinct run_id from (
  select json_extract_string(payload, '$.workflow_run.id') as run_id from webhooks
  where json_extract_string(payload, '$.action') in ('completed', 'failed')
  union all
  select cast(id as varchar) from polled_runs where id is not null) u where run_id is not null""")
def observed_runs(spark, sf):
    t = tables(spark, sf)
    return I.observed_runs(I.webhook_ingest(t.webhooks), t.polled_runs)


@register("append_failure_log", "select id, run_id, error_type, error_message, stack_trace, severity, created_at from failure_logs")
def append_failure_log(spark, sf):
    rows = I.failure_log_appends(K.analyze_failure(tables(spark, sf).job_logs))
    return I.append(rows, I.table_folder(spark, "failure_logs"))


@register("append_healing_action", """
select id, run_id, action_type, success, details, '' as changes_made, created_at from healing_actions""")
def append_healing_action(spark, sf):
    out = I.append(I.healing_action_appends(tables(spark, sf).healing_actions), I.table_folder(spark, "healing_actions"))
    return out.withColumn("changes_made", F.array_join("changes_made", " | "))


@register("record_metric", "select id, run_id, metric_name, metric_value, timestamp from metrics")
def record_metric(spark, sf):
    return I.append(I.metric_appends(tables(spark, sf).metrics, AS_OF), I.table_folder(spark, "metrics"))
