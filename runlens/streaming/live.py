"""Streams that can be stopped, killed and started again (M1-M6), into the tables of a ``Store``.

* The caller names the store, the checkpoint folder and the trigger; starting the same stream with the same
  checkpoint goes on after the last micro-batch that was published.
* The streams keep no operator state. A micro-batch is folded by itself into one row per key (or rows to
  append) and published as a part; a table is the merge of its parts, which is associative, so it is the same
  however the input was cut into batches, and the order of arrival plays no part. ``compact_every``
  batches the parts become one again.
* All tables of a micro-batch and its number are published in one version. A batch that is replayed after a crash
  is either in the list already and skipped, or not there and done anew: no row is lost or there twice.
* With a ``delay``, rows whose event time is more than that behind the latest one of earlier batches are late:
  they go to a table of their own, ``<stream>_late``, and no further row can reach older windows and ids, so
  compaction closes these and rewrites open ones only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import classify_ops as K
from ..operators import healing as H
from ..operators.scan import spread
from ..sources import ingest as I
from ..sources.versioned import Store, compact, current, merged

Fold = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Table:
    """A table that a stream feeds: what a micro-batch adds to it, and how rows of one key merge (no
    ``values``: rows are appended as they are)."""
    fold: Fold
    keys: list[str] = field(default_factory=list)
    values: dict[str, str] = field(default_factory=dict)
    closed: Callable[[int], str] | None = None  # SQL of rows that are complete once nothing older than so many microseconds comes


def start(stream: DataFrame, store: Store, name: str, tables: dict[str, Table], checkpoint: str, trigger: dict | None = None,
          time: Column | None = None, delay_seconds: float | None = None, compact_every: int = 16,
          prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Start ``stream`` into ``tables`` of ``store``. ``prepare`` is applied to each micro-batch once, and what it
    gives is kept while the tables are folded from it. ``trigger``: arguments of ``DataStreamWriter.trigger``."""
    micros = None if time is None else F.unix_micros(time.cast("timestamp"))

    def write(batch: DataFrame, number: int) -> None:
        state = store.state()
        if state["batches"].get(name, -1) >= number:
            return  # published before a crash that came ahead of the checkpoint
        mark = state["marks"].get(name)
        rows = (prepare(batch) if prepare else batch).persist()
        try:
            folds = {t: table.fold for t, table in tables.items()}
            if delay_seconds is not None:
                newest = rows.agg(F.max(micros)).first()[0]
                late = F.lit(False) if mark is None else F.coalesce(micros < mark - int(delay_seconds * 1e6), F.lit(False))
                on_time = rows.where(~late)
                staged = {t: on_time for t in folds}
                mark = max([x for x in (mark, newest) if x is not None], default=None)
                folds[f"{name}_late"] = lambda r: r
                staged[f"{name}_late"] = rows.where(late)
            else:
                staged = {t: rows for t in folds}
            parts = {}
            for t, fold in folds.items():
                df = fold(staged[t])
                parts[t] = (store.stage(df, batch=number, stream=name), df.schema)
        finally:
            rows.unpersist()

        def change(state: dict) -> dict | None:
            if state["batches"].get(name, -1) >= number:
                return None
            for t, (new, schema) in parts.items():
                store.put(state, t, schema, new)
            state["batches"][name] = number
            if mark is not None:
                state["marks"][name] = mark
            return state

        store.commit(change)
        if compact_every and number % compact_every == compact_every - 1:
            compact_all(store, name, tables, delay_seconds)

    return (stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
            .trigger(**(trigger or {"availableNow": True})).start())


def compact_all(store: Store, name: str, tables: dict[str, Table], delay_seconds: float | None = None) -> None:
    mark = store.state()["marks"].get(name)
    for t, table in tables.items():
        if table.values:
            border = None if mark is None or delay_seconds is None or table.closed is None else table.closed(mark - int(delay_seconds * 1e6))
            compact(store, t, table.keys, table.values, border)


def late_rows(store: Store, name: str) -> DataFrame:
    """Rows that came later than the stream's delay."""
    return store.read(f"{name}_late")


# ---------------------------------------------------------------------------------------------
# M1: webhook deliveries -> run table
# ---------------------------------------------------------------------------------------------

def _run_rows(deliveries: DataFrame) -> DataFrame:
    """Deliveries (``delivery_id, payload``) of accepted actions as mergeable rows per run."""
    r = I.webhook_ingest(deliveries).where((F.col("outcome") == "received") & F.col("run_id").isNotNull())
    r = r.select("run_id", F.struct("delivery_id", "repo", "started_at").alias("first"),
                 F.struct("delivery_id", "status", "conclusion", "completed_at").alias("last"))
    return merged(r, ["run_id"], RUNS.values)


RUNS = Table(_run_rows, ["run_id"], {"first": "min", "last": "max"})


def runs(store: Store, version: int | None = None) -> DataFrame:
    """The run table: a run keeps the repository and start of its first delivery and has the status,
    conclusion and completion of its last one."""
    r = current(store, "runs", RUNS.keys, RUNS.values, version)
    return r.select("run_id", "first.repo", "last.status", "last.conclusion", "first.started_at", "last.completed_at")


def webhook_runs(stream: DataFrame, store: Store, checkpoint: str, **options) -> StreamingQuery:
    """M1: deliveries into the run table."""
    return start(stream, store, "webhook_runs", {"runs": RUNS}, checkpoint, **options)


# ---------------------------------------------------------------------------------------------
# M2: first observations
# ---------------------------------------------------------------------------------------------

FIRST_COLUMNS = ["seq", "name", "status", "conclusion"]


def _first_rows(polled: DataFrame) -> DataFrame:
    seen = F.struct(*FIRST_COLUMNS, F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return merged(polled.where("id is not null").select("id", seen.alias("seen")), ["id"], FIRST.values)


FIRST = Table(_first_rows, ["id"], {"seen": "min"}, closed=lambda border: f"seen.micros < {border}")


def first_observations(stream: DataFrame, store: Store, checkpoint: str, **options) -> StreamingQuery:
    """M2: the first observation (``seq, ts, id, ...``) of every run id. With a delay an id is
    remembered for that long after it was first seen; one that is seen again later counts as new."""
    return start(stream, store, "first_observations", {"first_observations": FIRST}, checkpoint, time=F.col("ts"), **options)


def observed(store: Store) -> DataFrame:
    state = store.state()
    parts = state["tables"]["first_observations"]["parts"]
    shut = [p for p in parts if p.get("closed")]
    rows = merged(store.frame("first_observations", [p for p in parts if not p.get("closed")], state), FIRST.keys, FIRST.values)
    rows = rows.unionByName(store.frame("first_observations", shut, state))
    return rows.select("id", *[f"seen.{c}" for c in FIRST_COLUMNS])


# ---------------------------------------------------------------------------------------------
# M3, M4: counters and the confidence gauge
# ---------------------------------------------------------------------------------------------

def _counts(deliveries: DataFrame) -> DataFrame:
    p = deliveries.withColumn("_p", F.from_json("payload", I.WEBHOOK))
    ok = F.col("_p.action").isin(I.ACCEPTED_ACTIONS)
    return p.agg(F.count_if(ok).alias("pipeline_runs_total"),
                 F.count_if(ok & (F.col("_p.workflow_run.conclusion") == "success")).alias("pipeline_success_total"),
                 F.lit(0).cast("bigint").alias("healing_actions_total"))


COUNTED = {"pipeline_runs_total": "sum", "pipeline_success_total": "sum", "healing_actions_total": "sum"}
RUN_COUNTS = Table(_counts, [], COUNTED)


def _action_counts(actions: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return actions.agg(zero.alias("pipeline_runs_total"), zero.alias("pipeline_success_total"),
                       F.count(F.lit(1)).alias("healing_actions_total"))


ACTION_COUNTS = Table(_action_counts, [], COUNTED)


def count_runs(stream: DataFrame, store: Store, checkpoint: str, **options) -> StreamingQuery:
    """M3: received runs and successful ones, from deliveries."""
    return start(stream, store, "count_runs", {"counters": RUN_COUNTS}, checkpoint, **options)


def count_actions(stream: DataFrame, store: Store, checkpoint: str, **options) -> StreamingQuery:
    """M3: healing actions; a second stream into the same counters."""
    return start(stream, store, "count_actions", {"counters": ACTION_COUNTS}, checkpoint, **options)


def counters(store: Store) -> DataFrame:
    return current(store, "counters", [], COUNTED)


def last_confidence(stream: DataFrame, store: Store, checkpoint: str, score: Fold, **options) -> StreamingQuery:
    """M4: the confidence of the newest scored row. ``score`` adds ``confidence`` to rows with ``id``: a
    saved model's ``predict_failure``, or a rule."""
    fold = lambda rows: score(rows).agg(F.max(F.struct(F.col("id").alias("last_id"), F.col("confidence").alias("last_confidence"))).alias("last"))
    return start(stream, store, "last_confidence", {"confidence": Table(fold, [], {"last": "max"})}, checkpoint, **options)


def confidence(store: Store) -> DataFrame:
    return current(store, "confidence", [], {"last": "max"}).select("last.last_confidence", "last.last_id")


def risk_rule(features: DataFrame) -> DataFrame:
    """The scoring rule (P8) as a confidence."""
    return H.failure_risk_score(features).withColumn("confidence", F.least(F.greatest("failure_score", F.lit(0.0)), F.lit(1.0)))


# ---------------------------------------------------------------------------------------------
# M5: failures -> logs, actions, reruns, notifications
# ---------------------------------------------------------------------------------------------

def type_rates(rates: DataFrame) -> Fold:
    """Probability of an analysed failure from the success rate of its type's earlier actions."""
    r = rates.select(F.col("action_type").alias("error_type"), "heal_probability")
    return lambda analysis: analysis.join(r, "error_type", "left")


def healing_model(model, decision: dict | None = None) -> Fold:
    """Probability from a healing model (L7), e.g. one that ``ml.load_models`` has loaded."""
    from ..operators import ml as ML

    def probability(analysis: DataFrame) -> DataFrame:
        p = ML.predict_healing(model, H.healing_features(analysis), ["log_id"], decision)
        return analysis.join(p.select("log_id", F.col("probability").alias("heal_probability")), "log_id", "left")
    return probability


def heal_failures(logs: DataFrame, store: Store, checkpoint: str, repos: DataFrame, probability: Fold, context: Store,
                  **options) -> StreamingQuery:
    """M5: job logs of failed runs (``log_id, run_id, logs, created_at``) into four tables, published together:
    ``failure_logs``, ``healing_actions`` (what the gate lets through, successful or not), ``reruns`` (healed runs) and
    ``notifications`` (gate or healing said no).

    ``repos`` (``run_id, repo``) gives a run's repository. ``context`` is a store whose table ``context`` holds each
    repository's files and rollback commit; every micro-batch takes its newest version, and all plans of the
    batch go by that one."""
    def planned(batch: DataFrame) -> DataFrame:
        analysis = K.analyze_failure(spread(batch))
        analysis = probability(analysis).join(repos, "run_id", "left")
        plan = H.plan_healing(analysis, context.read("context", context.state()["version"]))
        plan = plan.select("log_id", "success", "action_type", "details", "changes_made")
        return H.heal_gate(analysis.join(plan, "log_id"), "heal_probability")

    healed = (F.col("decision") == "heal") & F.col("success")
    tables = {
        "failure_logs": Table(lambda r: I.failure_log_appends(r)),
        "healing_actions": Table(lambda r: I.healing_action_appends(
            r.where("decision = 'heal'").select(F.col("log_id").alias("id"), "run_id", "action_type", "success", "details", "created_at"))),
        "reruns": Table(lambda r: r.where(healed).select("log_id", "run_id")),
        "notifications": Table(lambda r: r.where(~F.coalesce(healed, F.lit(False))).select(
            "log_id", "run_id", "error_type", "heal_probability", "decision")),
    }
    return start(logs, store, "heal_failures", tables, checkpoint, prepare=planned, **options)


# ---------------------------------------------------------------------------------------------
# M6: rates over sliding windows
# ---------------------------------------------------------------------------------------------

def window_counts(size_seconds: int, slide_seconds: int) -> Table:
    def fold(events: DataFrame) -> DataFrame:
        w = F.window(F.col("ts").cast("timestamp"), f"{size_seconds} seconds", f"{slide_seconds} seconds")
        c = events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))
        return c.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                        "event_type", "events")
    return Table(fold, ["window_start", "window_end", "event_type"], {"events": "sum"},
                 closed=lambda border: f"unix_micros(cast(window_end as timestamp)) <= {border}")


def rate_windows(stream: DataFrame, store: Store, checkpoint: str, size_seconds: int = 300, slide_seconds: int = 60,
                 **options) -> StreamingQuery:
    """M6: events (``ts, event_type``) per type and sliding window."""
    return start(stream, store, "rate_windows", {"windows": window_counts(size_seconds, slide_seconds)}, checkpoint, time=F.col("ts"), **options)


def rates(store: Store, size_seconds: int = 300) -> DataFrame:
    t = window_counts(size_seconds, size_seconds)
    return current(store, "windows", t.keys, t.values).withColumn("rate", F.col("events") / float(size_seconds))
