"""Registered queries: restartable streams, each read back as a table and checked against the SQL of its
batch twin (M1-M7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import healing as H
from ..operators import runs as R
from ..operators import vcs as V
from ..operators.scan import written
from ..sources import ingest as I
from ..sources import json_files as JF
from ..sources import store as ST
from ..sources.tables import tables
from ..sources.versioned import Store
from ..streaming import live as L
from ..streaming import streams as S
from .q_healing import RATE_BY_TYPE, _plan_sql, _rates
from .q_ingest import J, _utc
from .q_runs import AS_OF, OLD_RUNS, RET_CUT
from .registry import register


def _arriving(spark, df, name: str, order: str, **slices):
    """A stream over an arrival folder filled from ``df``: as many micro-batches as slices, however many files a slice
    has. With ``cuts``, which a batch must not cross, a file each."""
    path = S.landing(df, name, order=order, **slices)
    return S.source(spark, path, df.schema, 1 if slices else S.files_per_slice(spark, path))


def _store(spark, name: str) -> tuple[Store, str]:
    return Store(spark, S._fresh(spark, "tables", name)), S._fresh(spark, "streams", name)


def _run(start, stream, name: str, *args, **options) -> Store:
    """Run a stream over all that has arrived; the store it filled."""
    store, checkpoint = _store(stream.sparkSession, name)
    start(stream, store, checkpoint, *args, **options).awaitTermination()
    return store


def _delivered(source: str) -> str:
    return f"""(select delivery_id, {J.format('$.workflow_run.id')} as run_id, {J.format('$.repository.full_name')} as repo,
    {J.format('$.workflow_run.status')} as status, {J.format('$.workflow_run.conclusion')} as conclusion,
    {_utc('$.workflow_run.created_at')} as started_at, {_utc('$.workflow_run.updated_at')} as completed_at
  from (select delivery_id, case when json_valid(payload) then payload end as payload from {source}) v
  where {J.format('$.action')} in ('completed', 'failed'))"""


DELIVERED = _delivered("run_deliveries")
RUNS_OF_DELIVERIES = """
select f.run_id, f.repo, l.status, l.conclusion, f.started_at, l.completed_at
from (select *, row_number() over (partition by run_id order by delivery_id) as rn from {0} d) f
join (select *, row_number() over (partition by run_id order by delivery_id desc) as rn from {0} d) l
  on f.run_id = l.run_id and f.rn = 1 and l.rn = 1"""


@register("stream_webhook_upsert", RUNS_OF_DELIVERIES.format(DELIVERED))
def stream_webhook_upsert(spark, sf):
    d = tables(spark, sf).run_deliveries.select("delivery_id", "payload")
    return L.runs(_run(L.webhook_runs, _arriving(spark, d, "run_deliveries", "delivery_id"), "webhook_runs", compact_every=2))


def _json_folder(spark, sf) -> str:
    """The deliveries as folders of JSON lines would hold them; a payload that is no JSON spoils its line, and each 89th
    delivery came without its id."""
    d = tables(spark, sf).run_deliveries
    number = F.when(F.col("delivery_id") % 89 == 3, F.lit("")).otherwise(F.concat(F.lit('"delivery_id":'), F.col("delivery_id").cast("string"), F.lit(",")))
    line = F.concat(F.lit("{"), number, F.lit('"event_type":"'), "event_type", F.lit('","payload":'), "payload", F.lit("}"))
    path = S._fresh(spark, "landing", "deliveries")
    d.select(line.alias("value")).repartition(3).write.text(path)
    return path


WITH_ID = "(select * from run_deliveries where delivery_id % 89 <> 3)"


@register("webhook_files", f"select delivery_id, run_id, repo, status, conclusion, started_at, completed_at from {_delivered(WITH_ID)} d")
def webhook_files(spark, sf):
    """S1 over JSON files in batch: accepted deliveries."""
    r = I.webhook_ingest(JF.usable(JF.read_deliveries(spark, _json_folder(spark, sf)))).where("outcome = 'received'")
    return r.drop("action", "outcome")


@register("stream_webhook_files", RUNS_OF_DELIVERIES.format(_delivered(WITH_ID)))
def stream_webhook_files(spark, sf):
    return L.runs(_run(JF.runs_from_files, JF.stream_deliveries(spark, _json_folder(spark, sf)), "runs_from_files"))


@register("webhook_quarantine", """
select case when payload = 'not json' then 'not json' else 'no delivery id' end as reason, count(*) as records
from run_deliveries where payload = 'not json' or delivery_id % 89 = 3 group by 1""")
def webhook_quarantine(spark, sf):
    store = _run(JF.runs_from_files, JF.stream_deliveries(spark, _json_folder(spark, sf)), "runs_from_files")
    return store.read("quarantine").groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


FIRST = """
select seq, id, name, status, conclusion from (
  select *, row_number() over (partition by id order by seq) as rn from polled_runs where id is not null) x
where rn = 1"""


def _polled(spark, sf):
    p = tables(spark, sf).events.select("event_id", "ts").join(
        tables(spark, sf).polled_runs.select(F.col("seq").alias("event_id"), "seq", "id", "name", "status", "conclusion"), "event_id")
    return _arriving(spark, p.drop("event_id"), "polled_runs", "seq")


@register("stream_first_observation", FIRST)
def stream_first_observation(spark, sf):
    return L.observed(_run(L.first_observations, _polled(spark, sf), "first_observations"))


@register("stream_first_observation_ttl", FIRST)
def stream_first_observation_ttl(spark, sf):
    """Ids are remembered for ten days only (more than a slice spans); in this table all observations of an id lie closer together."""
    return L.observed(_run(L.first_observations, _polled(spark, sf), "first_observations", delay_seconds=10 * 86400, compact_every=2))


@register("stream_counters", """
select count(*) filter (where json_extract_string(payload, '$.action') in ('completed', 'failed')) as pipeline_runs_total,
  count(*) filter (where json_extract_string(payload, '$.action') in ('completed', 'failed')
                   and json_extract_string(payload, '$.workflow_run.conclusion') = 'success') as pipeline_success_total,
  (select count(*) from healing_actions) as healing_actions_total
from webhooks""")
def stream_counters(spark, sf):
    t = tables(spark, sf)
    store, checkpoint = _store(spark, "counters")
    for start, df, key in ((L.count_runs, t.webhooks.select("delivery_id", "payload"), "delivery_id"), (L.count_actions, t.healing_actions.select("id"), "id")):
        start(_arriving(spark, df, key, key), store, f"{checkpoint}/{key}").awaitTermination()
    return L.counters(store)


@register("stream_last_confidence", """
select least(greatest(previous_failures * 0.15e0 + dependency_changes * 0.12e0 + (commit_size / 1000) * 0.10e0
  + ((100 - test_coverage) / 100) * 0.08e0 + (code_complexity / 30) * 0.07e0, 0e0), 1e0) as last_confidence, id as last_id
from run_features order by id desc limit 1""")
def stream_last_confidence(spark, sf):
    return L.confidence(_run(L.last_confidence, _arriving(spark, tables(spark, sf).run_features, "run_features", "id"), "confidence", L.risk_rule))


def _heal(spark, sf) -> Store:
    t = tables(spark, sf)
    attrs = written(V.run_attributes(t.run_events), "run-attributes")  # every micro-batch joins them
    context, _ = _store(spark, "repo_context")
    context.write({"context": H.repo_context(H.repo_file_pivot(t.repo_files), V.last_good_run(attrs))})
    logs = _arriving(spark, t.job_logs, "job_logs", "log_id")
    return _run(L.heal_failures, logs, "heal_failures", attrs.select("run_id", "repo"), L.type_rates(written(_rates(t), "type-rates")), context)


@register("stream_failure_pipeline", "select id, run_id, error_type, error_message, stack_trace, severity, created_at from failure_logs")
def stream_failure_pipeline(spark, sf):
    return _heal(spark, sf).read("failure_logs")


GATED = f"""(select f.log_id, f.run_id, f.error_type, f.created_at, r.heal_probability,
    case when r.heal_probability > 0.7e0 then 'heal' else 'notify' end as decision, p.success, p.action_type, p.details
  from failure_analysis f left join ({RATE_BY_TYPE}) r on f.error_type = r.action_type join ({_plan_sql()}) p on p.log_id = f.log_id) g"""


@register("stream_notifications", f"""
select log_id, run_id, error_type, heal_probability, decision from {GATED} where not (decision = 'heal' and coalesce(success, false))""")
def stream_notifications(spark, sf):
    return _heal(spark, sf).read("notifications")


@register("stream_healing_actions", f"""
select log_id as id, run_id, action_type, success, details, 0 as n_changes, created_at from {GATED} where decision = 'heal'""")
def stream_healing_actions(spark, sf):
    a = _heal(spark, sf).read("healing_actions")
    return a.withColumn("n_changes", F.size("changes_made")).drop("changes_made")


@register("stream_reruns", f"select log_id, run_id from {GATED} where decision = 'heal' and success")
def stream_reruns(spark, sf):
    return _heal(spark, sf).read("reruns")


WINDOWS = """
select window_start, window_start + interval 5 minute as window_end, event_type, count(*) as events, count(*) / 300e0 as rate
from (select make_timestamp(cast((floor(epoch_us(ts) / 60000000e0) - k) * 60000000 as bigint)) as window_start, event_type
      from {events}, range(0, 5) t(k)) x
group by window_start, event_type"""


@register("stream_rate_windows", WINDOWS.format(events="events"))
def stream_rate_windows(spark, sf):
    events = tables(spark, sf).events.select("event_id", "ts", "event_type")
    return L.rates(_run(L.rate_windows, _arriving(spark, events, "events", "event_id"), "rate_windows"))


ARRIVING = """(select *, case when event_id % 50 = 7 then 4 else least(cast(floor(date_diff('day', date '2024-01-01', cast(ts as date)) / 8e0) as int), 3) end as arrival
  from events)"""
LATE = f"""(select *, arrival = 4 and ts < (select max(ts) from {ARRIVING} a where arrival < 4) - interval 9 day as late from {ARRIVING} b)"""


def _late(spark, sf) -> Store:
    events = S.late_arrivals(tables(spark, sf).events.select("event_id", "ts", "event_type"))
    stream = _arriving(spark, events, "late_events", "arrival", cuts=[0, 1, 2, 3])
    return _run(L.rate_windows, stream, "rate_windows", delay_seconds=9 * 86400, compact_every=2)


@register("stream_rate_windows_delayed", WINDOWS.format(events=f"(select * from {LATE} c where not late) d"))
def stream_rate_windows_delayed(spark, sf):
    """Windows that close nine days behind the newest event (more than a slice spans, whose files come in any order); rows that
    come later do not count."""
    return L.rates(_late(spark, sf))


@register("stream_late_events", f"select event_type, count(*) as late, min(ts) as first_ts, max(ts) as last_ts from {LATE} c where late group by event_type")
def stream_late_events(spark, sf):
    r = L.late_rows(_late(spark, sf), "rate_windows")
    return r.groupBy("event_type").agg(F.count(F.lit(1)).alias("late"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _retained(spark, sf) -> Store:
    t = tables(spark, sf)
    store = ST.write_tables(t.runs, t.failure_logs, t.healing_actions, t.metrics, S._fresh(spark, "tables", "retention"))
    ST.apply_retention(store, AS_OF, days=30)  # names old days' parts no more, rewrites the cutoff day's
    return store


@register("stream_retention", f"select * from pipeline_runs where not (created_at < {RET_CUT}) or created_at is null")
def stream_retention(spark, sf):
    return _retained(spark, sf).read("runs")


@register("stream_retention_failures", f"select * from failure_logs where run_id not in {OLD_RUNS}")
def stream_retention_failures(spark, sf):
    return _retained(spark, sf).read("failure_logs")


@register("stream_retention_actions", f"select * from healing_actions where run_id not in {OLD_RUNS}")
def stream_retention_actions(spark, sf):
    return _retained(spark, sf).read("healing_actions")


@register("stream_retention_metrics", f"select * from metrics where not (timestamp < {RET_CUT}) or timestamp is null")
def stream_retention_metrics(spark, sf):
    return _retained(spark, sf).read("metrics")


@register("stored_run_upsert", "select * from pipeline_runs")
def stored_run_upsert(spark, sf):
    """S9 into the stored table: two thirds of the events first, then the rest into the parts they touch."""
    t = tables(spark, sf)
    events, cut = t.run_events, F.lit("2024-01-20").cast("timestamp_ntz")
    base = S._fresh(spark, "tables", "runs")
    store = ST.write_tables(R.run_upsert(events.where(F.col("ts") < cut)), t.failure_logs, t.healing_actions, t.metrics, base)
    ST.upsert_runs(store, events.where(~(F.col("ts") < cut)))
    return store.read("runs")
