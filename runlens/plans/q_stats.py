"""Registered queries: healing statistics and dashboard figures."""

from __future__ import annotations

from ..operators import stats as S
from ..sources.tables import tables
from .q_runs import AS_OF, AS_OF_SQL
from .registry import register


def r2(x: str) -> str:
    """Half-up rounding to 2 places of the printed value (Spark ``round`` on doubles)."""
    return f"cast(round(cast({x} as decimal(38, 9)), 2) as double)"


@register("healing_stats_by_action", f"""
select total_failures, healing_attempted, healing_successful,
  case when healing_attempted > 0 then {r2('healing_successful / healing_attempted * 100')} else 0e0 end as success_rate,
  healing_successful * 15 as time_saved, {r2('healing_successful * 1.5e0')} as cost_saved
from (select
  (select count(*) from pipeline_runs where conclusion = 'failure' and created_at >= {AS_OF_SQL} - interval 30 day) as total_failures,
  (select count(*) from healing_actions where created_at >= {AS_OF_SQL} - interval 30 day) as healing_attempted,
  (select count(*) from healing_actions where success and created_at >= {AS_OF_SQL} - interval 30 day) as healing_successful) x""")
def healing_stats_by_action(spark, sf):
    t = tables(spark, sf)
    return S.healing_stats_by_action(t.runs, t.healing_actions, as_of=AS_OF, days=30)


@register("healing_stats_by_run", f"""
select total_failures, healing_attempted, healing_successful,
  {r2('100e0 * healing_successful / nullif(total_failures, 0)')} as success_rate_percentage
from (select
  count(*) filter (where conclusion = 'failure') as total_failures,
  count(*) filter (where exists (select 1 from healing_actions ha where ha.run_id = r.run_id)) as healing_attempted,
  count(*) filter (where exists (select 1 from healing_actions ha where ha.run_id = r.run_id and ha.success)) as healing_successful
  from pipeline_runs r where created_at >= {AS_OF_SQL} - interval 30 day) x""")
def healing_stats_by_run(spark, sf):
    t = tables(spark, sf)
    return S.healing_stats_by_run(t.runs, t.healing_actions, as_of=AS_OF, days=30)


CM = """count(*) filter (where label = 0 and prediction = 0) as tn, count(*) filter (where label = 0 and prediction = 1) as fp,
  count(*) filter (where label = 1 and prediction = 0) as fn, count(*) filter (where label = 1 and prediction = 1) as tp"""


def metrics_sql(src: str) -> str:
    return f"""
select tp, fp, fn, tn, accuracy, precision, recall,
  case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0e0 end as f1
from (select tp, fp, fn, tn,
  case when tp + fp + fn + tn > 0 then (tp + tn) / cast(tp + fp + fn + tn as double) else 0e0 end as accuracy,
  case when tp + fp > 0 then tp / cast(tp + fp as double) else 0e0 end as precision,
  case when tp + fn > 0 then tp / cast(tp + fn as double) else 0e0 end as recall
  from (select {CM} from {src}) c) m"""


@register("confusion_matrix", f"select {CM} from predictions")
def confusion_matrix(spark, sf):
    return S.confusion_matrix(tables(spark, sf).predictions)


@register("classifier_metrics", metrics_sql("predictions"))
def classifier_metrics(spark, sf):
    return S.classifier_metrics(tables(spark, sf).predictions)


@register("classifier_metrics_labels", metrics_sql("(select quality as label, toxic as prediction from labels) l"))
def classifier_metrics_labels(spark, sf):
    return S.classifier_metrics(tables(spark, sf).labels, label="quality", prediction="toxic")


@register("failure_rate", "select avg(cast(label as double)) * 100 as failure_rate, count(*) as samples from predictions")
def failure_rate(spark, sf):
    return S.failure_rate(tables(spark, sf).predictions)


@register("healing_sample_check", """
select n_samples, n_classes, case when n_samples < 50 then 'skip' when n_classes < 2 then 'majority_class' else 'train' end as decision
from (select count(*) as n_samples, count(distinct success) as n_classes from healing_actions a
      where run_id in (select run_id from pipeline_runs where conclusion = 'failure')) x""")
def healing_sample_check(spark, sf):
    t = tables(spark, sf)
    failed = t.runs.filter("conclusion = 'failure'").select("run_id")
    return S.healing_sample_check(t.healing_actions.join(failed, "run_id", "left_semi"))


@register("healing_success_rate", """
select avg(cast(success as double)) * 100 as success_rate, count(*) as actions from healing_actions""")
def healing_success_rate(spark, sf):
    return S.healing_success_rate(tables(spark, sf).healing_actions)


DUR = "(epoch_us(a.created_at) - epoch_us(r.started_at))"


@register("avg_healing_time", f"""
select cast(sum({DUR}) as bigint) / count({DUR}) / 1e6 as avg_healing_seconds, count({DUR}) as actions
from healing_actions a left join pipeline_runs r on a.run_id = r.run_id""")
def avg_healing_time(spark, sf):
    t = tables(spark, sf)
    return S.avg_healing_time(t.runs, t.healing_actions)


@register("savings_total", f"""
select {r2('count(*) filter (where success) * 1.5e0')} as cost_saved_usd,
  count(*) filter (where success) * 15 / 60e0 as hours_saved from healing_actions""")
def savings_total(spark, sf):
    return S.savings_total(tables(spark, sf).healing_actions)


@register("pipeline_counters", """
select (select count(*) from pipeline_runs) as pipeline_runs_total,
  (select count(*) from pipeline_runs where conclusion = 'success') as pipeline_success_total,
  (select count(*) from healing_actions) as healing_actions_total""")
def pipeline_counters(spark, sf):
    t = tables(spark, sf)
    return S.pipeline_counters(t.runs, t.healing_actions)


def _color(v: str, th: list) -> str:
    whens = " ".join(f"when {v} >= {t} then '{c}'" for t, c in reversed(th[1:]))
    return f"case when {v} is null then null {whens} else '{th[0][1]}' end"


@register("threshold_color", f"""
select day, success_rate, {_color('success_rate', S.SUCCESS_RATE_THRESHOLDS)} as success_color,
  avg_healing_seconds, {_color('avg_healing_seconds', S.HEALING_TIME_THRESHOLDS)} as time_color,
  hours_saved, {_color('hours_saved', S.HOURS_SAVED_THRESHOLDS)} as hours_color
from (select date_trunc('day', a.created_at) as day, avg(cast(a.success as double)) * 100 as success_rate,
        cast(sum({DUR}) as bigint) / count({DUR}) / 1e6 as avg_healing_seconds, count(*) filter (where a.success) * 15 / 60e0 as hours_saved
      from healing_actions a left join pipeline_runs r on a.run_id = r.run_id group by 1) g""")
def threshold_color(spark, sf):
    t = tables(spark, sf)
    return S.daily_panel_colors(t.runs, t.healing_actions)
