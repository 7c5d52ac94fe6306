"""Registered queries: run table, lookups, joins to actions, retention (S5, S9, S10, S13, P1, P2,
J1-J3, J9, J10, J12, T1, T2, W1, W3, W4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from ..sources import ingest as I
from ..sources.tables import tables
from .registry import register

AS_OF = R.DEFAULT_AS_OF
AS_OF_SQL = f"timestamp '{AS_OF}'"
SERIES_AS_OF = "2024-01-20 00:00:00"
SPLIT_TS = "2024-01-15 00:00:00"


@register("run_upsert", "select * from pipeline_runs")
def run_upsert(spark, sf):
    t = tables(spark, sf)
    ev = t.run_events
    older = ev.filter(F.col("ts") < R.ts_lit(SPLIT_TS))
    newer = ev.filter(~(F.col("ts") < R.ts_lit(SPLIT_TS)) | F.col("ts").isNull())
    return R.run_upsert(newer, target=R.run_upsert(older))


@register("table_scan", """
select run_id, status, conclusion, created_at, completed_at from pipeline_runs
where run_id in (select run_id from failure_logs)""")
def table_scan(spark, sf):
    t = tables(spark, sf)
    return R.workflow_status(t.runs, _log_ids(t))


def _log_ids(t):
    """Ids and runs of the failure logs: one per job log, so nothing needs to be analysed for them."""
    return t.job_logs.select(F.col("log_id").alias("id"), "run_id")


@register("active_runs", """
select cast(l.run_id as bigint) as id, l.repo as name, l.status, f.created_at, l.head_branch, l.head_sha, l.event, l.author,
  'https://ci.example.com/' || l.repo || '/actions/runs/' || l.run_id as url
from (select *, row_number() over (partition by run_id order by seq desc) as rn from run_events) l
join (select run_id, min(ts) as created_at from run_events group by run_id) f on l.run_id = f.run_id
where l.rn = 1 and l.status = 'in_progress'""")
def active_runs(spark, sf):
    return R.active_runs(tables(spark, sf).run_events)


@register("effective_status", """
select seq, id, coalesce(name, '<unnamed>') as name, coalesce(conclusion, status, 'unknown') as effective_status
from polled_runs""")
def effective_status(spark, sf):
    return R.effective_status(tables(spark, sf).polled_runs)


FIRST_ACTION_SQL = """select run_id, id as action_id, action_type, success from (
  select *, row_number() over (partition by run_id order by id) as rn from healing_actions) a where rn = 1"""


@register("first_action_per_run", FIRST_ACTION_SQL)
def first_action_per_run(spark, sf):
    return R.first_action_per_run(tables(spark, sf).healing_actions)


@register("recent_runs", f"""
select r.*, false as failure_predicted, fa.action_id is not null as healing_attempted,
  coalesce(fa.success, false) as healing_successful
from (select * from pipeline_runs order by created_at desc, id desc limit 10) r
left join ({FIRST_ACTION_SQL}) fa on r.run_id = fa.run_id""")
def recent_runs(spark, sf):
    t = tables(spark, sf)
    return R.recent_runs(t.runs, t.healing_actions, limit=10)


@register("failure_patterns_report", f"""
select f.error_type, count(*) as count, coalesce(avg(cast(fa.success as double)), 0) * 100 as healing_success_rate
from failure_logs f left join ({FIRST_ACTION_SQL}) fa on f.run_id = fa.run_id
where f.created_at >= {AS_OF_SQL} - interval 30 day
group by f.error_type""")
def failure_patterns_report(spark, sf):
    t = tables(spark, sf)
    return R.failure_patterns_report(t.failure_logs, t.healing_actions, as_of=AS_OF, days=30)


@register("healing_history", """
select r.run_id, r.status, r.conclusion, coalesce(f.n_failures, 0) as n_failures, f.first_failure_id, f.last_failure_id,
  coalesce(a.n_actions, 0) as n_actions, a.first_action_id, a.last_action_id, coalesce(a.n_successful, 0) as n_successful
from pipeline_runs r
left join (select run_id, count(*) as n_failures, min(id) as first_failure_id, max(id) as last_failure_id
           from failure_logs group by run_id) f on r.run_id = f.run_id
left join (select run_id, count(*) as n_actions, min(id) as first_action_id, max(id) as last_action_id,
                  count(*) filter (where success) as n_successful
           from healing_actions group by run_id) a on r.run_id = a.run_id""")
def healing_history(spark, sf):
    t = tables(spark, sf)
    return R.healing_history(t.runs, _log_ids(t), t.healing_actions)


@register("healing_history_rows", """
select r.run_id, c.kind, c.child_id, c.label, c.created_at from pipeline_runs r join (
  select run_id, 'failure' as kind, id as child_id, error_type as label, created_at from failure_logs
  union all
  select run_id, 'healing_action' as kind, id as child_id, action_type as label, created_at from healing_actions) c
on r.run_id = c.run_id""")
def healing_history_rows(spark, sf):
    t = tables(spark, sf)
    return R.healing_history_rows(t.runs, t.failure_logs, t.healing_actions)


@register("unhealed_failures", """
select run_id, repo, created_at from pipeline_runs r
where conclusion = 'failure' and not exists (select 1 from healing_actions a where a.run_id = r.run_id)""")
def unhealed_failures(spark, sf):
    t = tables(spark, sf)
    return R.unhealed_failures(t.runs, t.healing_actions)


@register("runs_with_action", """
select run_id, status, conclusion from pipeline_runs r
where exists (select 1 from healing_actions a where a.run_id = r.run_id)""")
def runs_with_action(spark, sf):
    t = tables(spark, sf)
    return R.runs_with_action(t.runs, t.healing_actions)


@register("runs_with_success", """
select run_id, status, conclusion from pipeline_runs r
where exists (select 1 from healing_actions a where a.run_id = r.run_id and a.success)""")
def runs_with_success(spark, sf):
    t = tables(spark, sf)
    return R.runs_with_action(t.runs, t.healing_actions, successful=True)


@register("orphan_check", f"""
with recent as (select run_id from pipeline_runs where created_at >= {AS_OF_SQL} - interval 30 day)
select 'failure_logs' as child, id, run_id from failure_logs f where run_id not in (select run_id from recent)
union all
select 'healing_actions' as child, id, run_id from healing_actions a where run_id not in (select run_id from recent)""")
def orphan_check(spark, sf):
    t = tables(spark, sf)
    recent = t.runs.filter(F.col("created_at") >= R.cutoff(AS_OF, days=30))
    return R.orphan_check(recent, _log_ids(t), t.healing_actions)


@register("recent_failures", """
select * from pipeline_runs where status = 'completed' and conclusion = 'failure'
order by created_at desc, id desc limit 10""")
def recent_failures(spark, sf):
    return R.recent_failures(tables(spark, sf).runs, limit=10)


@register("metric_series", f"""
select * from metrics where metric_name = 'purchase' and timestamp >= timestamp '{SERIES_AS_OF}' - interval 24 hour
order by timestamp, id""")
def metric_series(spark, sf):
    return R.metric_series(tables(spark, sf).metrics, "purchase", hours=24, as_of=SERIES_AS_OF)


@register("consecutive_dedupe", """
select seq, id, name, status, conclusion from (
  select *, lag(id) over (order by seq) as prev_id from polled_runs where id is not null and id <> 0) x
where prev_id is null or prev_id <> id""")
def consecutive_dedupe(spark, sf):
    return R.consecutive_dedupe(tables(spark, sf).polled_runs)


@register("first_observation", """
select seq, id, name, status, conclusion from (
  select *, row_number() over (partition by id order by seq) as rn from polled_runs where id is not null) x
where rn = 1""")
def first_observation(spark, sf):
    return R.first_observation(tables(spark, sf).polled_runs)


@register("first_observation_by_status", """
select seq, id, name, status, conclusion from (
  select *, row_number() over (partition by id, coalesce(conclusion, status, 'unknown') order by seq) as rn
  from polled_runs where id is not null) x
where rn = 1""")
def first_observation_by_status(spark, sf):
    return R.first_observation(tables(spark, sf).polled_runs, key=("id", "effective_status"))


RET_CUT = f"{AS_OF_SQL} - interval 30 day"
OLD_RUNS = f"(select run_id from pipeline_runs where created_at < {RET_CUT})"


@register("retention_runs", f"select * from pipeline_runs where not (created_at < {RET_CUT}) or created_at is null")
def retention_runs(spark, sf):
    t = tables(spark, sf)
    return R.retention(t.runs, t.failure_logs, t.healing_actions, t.metrics, as_of=AS_OF, days=30)["runs"]


@register("retention_failures", f"select * from failure_logs where run_id not in {OLD_RUNS}")
def retention_failures(spark, sf):
    t = tables(spark, sf)
    return R.retention(t.runs, t.failure_logs, t.healing_actions, t.metrics, as_of=AS_OF, days=30)["failure_logs"]


@register("retention_actions", f"select * from healing_actions where run_id not in {OLD_RUNS}")
def retention_actions(spark, sf):
    t = tables(spark, sf)
    return R.retention(t.runs, t.failure_logs, t.healing_actions, t.metrics, as_of=AS_OF, days=30)["healing_actions"]


@register("retention_metrics", f"select * from metrics where not (timestamp < {RET_CUT}) or timestamp is null")
def retention_metrics(spark, sf):
    t = tables(spark, sf)
    return R.retention(t.runs, t.failure_logs, t.healing_actions, t.metrics, as_of=AS_OF, days=30)["metrics"]


def _iso(c: str) -> str:
    return (f"case when {c} is null then null when microsecond({c}) % 1000000 = 0 then strftime({c}, '%Y-%m-%dT%H:%M:%S') "
            f"else strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') end")


def _row(table: str) -> str:
    """A row of a table as a DuckDB struct, as it is serialised."""
    shape = {"details": "details::json", "changes_made": "[]::varchar[]"}
    return "struct_pack(" + ", ".join(f"{c} := " + (_iso(c) if c.endswith("_at") or c == "timestamp" else shape.get(c, c))
                                      for c in R.SERIALIZED[table]) + ")"


def _row_sql(table: str, source: str) -> str:
    return f"select id, to_json({_row(table)})::varchar as json from {source}"


@register("row_serialize", _row_sql("runs", "pipeline_runs"))
def row_serialize(spark, sf):
    return R.serialize_runs(tables(spark, sf).runs)


@register("row_serialize_failures", _row_sql("failure_logs", "failure_logs"))
def row_serialize_failures(spark, sf):
    return R.serialize_rows(tables(spark, sf).failure_logs, "failure_logs")


def _actions(t):
    return I.healing_action_appends(t.healing_actions)


@register("row_serialize_actions", _row_sql("healing_actions", "healing_actions"))
def row_serialize_actions(spark, sf):
    return R.serialize_rows(_actions(tables(spark, sf)), "healing_actions")


@register("row_serialize_metrics", _row_sql("metrics", "metrics"))
def row_serialize_metrics(spark, sf):
    return R.serialize_rows(tables(spark, sf).metrics, "metrics")


def _pages_sql(page: int) -> str:
    child = lambda table: (f"(select run_id, (row_number() over (partition by run_id order by id) - 1) // {page} as page, id, "  # noqa: E731
                           f"{_row(table)} as r from {table})")
    listed = lambda table: f"(select run_id, page, to_json(list(r order by id))::varchar as rows from {child(table)} c group by run_id, page)"
    return f"""
with f as {listed('failure_logs')}, a as {listed('healing_actions')},
n as (select run_id, page from f union select run_id, page from a union select run_id, 0 from pipeline_runs)
select n.run_id, n.page, to_json({_row('runs')})::varchar as run, coalesce(f.rows, '[]') as failures, coalesce(a.rows, '[]') as healing_actions
from pipeline_runs r join n on n.run_id = r.run_id left join f on f.run_id = n.run_id and f.page = n.page left join a on a.run_id = n.run_id and a.page = n.page"""


def _pages(p):
    rows = lambda name, table: F.concat(F.lit("["), F.array_join(F.transform(name, lambda r: R.as_json(R.serialized(table, lambda c: r[c]))), ","), F.lit("]"))
    return p.select("run_id", "page", R.as_json(R.serialized("runs")).alias("run"), rows("failures", "failure_logs").alias("failures"),
                    rows("healing_actions", "healing_actions").alias("healing_actions"))


@register("healing_history_pages", _pages_sql(100).replace("struct_pack(id := id, run_id := run_id, repo", "struct_pack(id := id, run_id := r.run_id, repo"))
def healing_history_pages(spark, sf):
    """J3 with all children, a hundred to a page."""
    t = tables(spark, sf)
    return _pages(R.history_pages(t.runs, t.failure_logs, _actions(t)))
