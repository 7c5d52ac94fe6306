"""Run-table operators: upsert, lookups, run/failure/action joins, retention (S5, S9, S10,
S13, P1, P2, J1-J3, J9, J10, J12, T1, T2, W1, W3, W4).

First/last row per key is always an aggregate (``min_by``/``max_by`` on a unique sequence)
rather than ``row_number`` over a window: aggregates combine map-side, so a run id that holds a
large share of the events is reduced in every task before the shuffle.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import lag_by, running

DEFAULT_AS_OF = "2024-02-10 00:00:00"


def ts_lit(value: str | _dt.datetime) -> Column:
    """A zone-less timestamp literal (the tables hold TIMESTAMP_NTZ)."""
    return F.lit(str(value)).cast("timestamp_ntz")


def cutoff(as_of: str, days: float = 0, hours: float = 0) -> Column:
    t = _dt.datetime.fromisoformat(str(as_of)) - _dt.timedelta(days=days, hours=hours)
    return ts_lit(t.isoformat(sep=" "))


# ---------------------------------------------------------------------------------------------
# S9 upsert
# ---------------------------------------------------------------------------------------------

RUN_COLUMNS = ["id", "run_id", "repo", "status", "conclusion", "started_at", "completed_at", "created_at"]


def run_upsert(updates: DataFrame, target: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """Fold run events (``seq, run_id, ts, repo, status, conclusion``) into one row per run.

    A new run takes repo and start time from its first event. Later events update only status,
    conclusion and completed_at (set when the latest status is ``completed``). With a ``target``
    run table, runs already there keep their id, repo, started_at and created_at.
    """
    g = updates.groupBy("run_id").agg(
        F.min_by(F.struct(F.col("repo"), F.col("ts")), F.col(seq)).alias("f"),
        F.max_by(F.struct(F.col("status"), F.col("conclusion"), F.col("ts")), F.col(seq)).alias("l"),
    )
    new = g.select(
        F.col("run_id").try_cast("bigint").alias("id"), "run_id", F.col("f.repo").alias("repo"),
        F.col("l.status").alias("status"), F.col("l.conclusion").alias("conclusion"),
        F.col("f.ts").alias("started_at"),
        F.when(F.col("l.status") == "completed", F.col("l.ts")).alias("completed_at"),
        F.col("f.ts").alias("created_at"),
    )
    if target is None:
        return new
    t, n = target.alias("t"), new.alias("n")
    j = t.join(n, F.col("t.run_id") == F.col("n.run_id"), "full_outer")
    has_t = F.col("t.run_id").isNotNull()
    has_n = F.col("n.run_id").isNotNull()
    keep = lambda c: F.when(has_t, F.col(f"t.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    upd = lambda c: F.when(has_n, F.col(f"n.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    return j.select(keep("id"), keep("run_id"), keep("repo"), upd("status"), upd("conclusion"),
                    keep("started_at"), upd("completed_at"), keep("created_at"))


# ---------------------------------------------------------------------------------------------
# S5 scans and lookups
# ---------------------------------------------------------------------------------------------

def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    """One run by key (the filter is pushed to the scan / through the aggregate)."""
    return runs.filter(F.col("run_id") == F.lit(str(run_id)))


def workflow_status(runs: DataFrame, run_ids: DataFrame) -> DataFrame:
    """S5 batch form: status rows for a set of run ids (semi join, no driver list)."""
    return runs.join(run_ids.select("run_id").distinct(), "run_id", "left_semi") \
               .select("run_id", "status", "conclusion", "created_at", "completed_at")


# ---------------------------------------------------------------------------------------------
# P1, P2
# ---------------------------------------------------------------------------------------------

RUN_URL_BASE = "https://ci.example.com/"


def active_runs(run_events: DataFrame, url_base: str = RUN_URL_BASE) -> DataFrame:
    """Runs whose latest state is ``in_progress`` with the nine run attributes."""
    g = run_events.groupBy("run_id").agg(
        F.max_by(F.struct("status", "repo", "head_branch", "head_sha", "event", "author"), F.col("seq")).alias("l"),
        F.min("ts").alias("created_at"),
    )
    return g.filter(F.col("l.status") == "in_progress").select(
        F.col("run_id").try_cast("bigint").alias("id"),
        F.col("l.repo").alias("name"),
        F.col("l.status").alias("status"),
        "created_at",
        F.col("l.head_branch").alias("head_branch"),
        F.col("l.head_sha").alias("head_sha"),
        F.col("l.event").alias("event"),
        F.col("l.author").alias("author"),
        F.concat(F.lit(url_base), F.col("l.repo"), F.lit("/actions/runs/"), F.col("run_id")).alias("url"),
    )


def effective_status(polled: DataFrame) -> DataFrame:
    """Conclusion, else status, else ``unknown``; missing name -> ``<unnamed>``."""
    return polled.select(
        "seq", "id",
        F.coalesce("name", F.lit("<unnamed>")).alias("name"),
        F.coalesce("conclusion", "status", F.lit("unknown")).alias("effective_status"),
    )


# ---------------------------------------------------------------------------------------------
# W1 and joins to actions
# ---------------------------------------------------------------------------------------------

def first_action_per_run(actions: DataFrame) -> DataFrame:
    """The first healing action of each run (smallest id)."""
    g = actions.groupBy("run_id").agg(F.min_by(F.struct("id", "action_type", "success"), F.col("id")).alias("a"))
    return g.select("run_id", F.col("a.id").alias("action_id"), F.col("a.action_type").alias("action_type"),
                    F.col("a.success").alias("success"))


def recent_runs(runs: DataFrame, actions: DataFrame, limit: int = 10) -> DataFrame:
    """Newest ``limit`` runs with their first healing action's outcome.

    The top-k runs meet the actions in one join, and their first action comes from the aggregate over its
    ``limit`` groups; the join is a broadcast only if Spark measures the k rows as small enough.
    """
    top = runs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    acts = actions.select("run_id", F.struct(F.col("id").alias("action_id"), "success").alias("_a"))
    j = top.join(acts, "run_id", "left").groupBy(*RUN_COLUMNS).agg(F.min("_a").alias("_a"))
    return j.select(
        *RUN_COLUMNS,
        F.lit(False).alias("failure_predicted"),
        F.col("_a").isNotNull().alias("healing_attempted"),
        F.coalesce(F.col("_a.success"), F.lit(False)).alias("healing_successful"),
    )


def failure_patterns_report(failure_logs: DataFrame, actions: DataFrame, as_of: str = DEFAULT_AS_OF,
                            days: int = 30) -> DataFrame:
    """Failures of the last ``days`` per error type with the first-action healing success rate.

    The correlated "success of the run's action" is decorrelated into a join to the first
    action per run (an aggregate, one row per run), then a grouped average; failures whose run
    has no action do not count in the average, and no action at all gives 0. The most frequent type is first.
    """
    recent = failure_logs.filter(F.col("created_at") >= cutoff(as_of, days=days))
    first = first_action_per_run(actions).select("run_id", F.col("success").cast("double").alias("ok"))
    j = recent.join(first, "run_id", "left")
    return j.groupBy("error_type").agg(
        F.count(F.lit(1)).alias("count"),
        (F.coalesce(F.avg("ok"), F.lit(0.0)) * 100).alias("healing_success_rate"),
    ).orderBy(F.desc("count"), "error_type")


def healing_history(runs: DataFrame, failure_logs: DataFrame, actions: DataFrame) -> DataFrame:
    """Per run, its failures and healing actions, as counts and id ranges.

    The nested lists of the service are unbounded per run, so they are not collected into one
    row; ``healing_history_rows`` gives the children as rows instead.
    """
    f = failure_logs.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_failures"),
                                           F.min("id").alias("first_failure_id"), F.max("id").alias("last_failure_id"))
    a = actions.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_actions"),
                                      F.min("id").alias("first_action_id"), F.max("id").alias("last_action_id"),
                                      F.count_if(F.col("success")).alias("n_successful"))
    j = runs.join(f, "run_id", "left").join(a, "run_id", "left")
    return j.select("run_id", "status", "conclusion",
                    F.coalesce("n_failures", F.lit(0)).alias("n_failures"), "first_failure_id", "last_failure_id",
                    F.coalesce("n_actions", F.lit(0)).alias("n_actions"), "first_action_id", "last_action_id",
                    F.coalesce("n_successful", F.lit(0)).alias("n_successful"))


def healing_history_rows(runs: DataFrame, failure_logs: DataFrame, actions: DataFrame) -> DataFrame:
    """J3 long form: one row per (run, child) with the child's kind and id."""
    f = failure_logs.select("run_id", F.lit("failure").alias("kind"), F.col("id").alias("child_id"),
                            F.col("error_type").alias("label"), "created_at")
    a = actions.select("run_id", F.lit("healing_action").alias("kind"), F.col("id").alias("child_id"),
                       F.col("action_type").alias("label"), "created_at")
    return runs.select("run_id").join(f.unionByName(a), "run_id", "inner")


def history_pages(runs: DataFrame, failure_logs: DataFrame, actions: DataFrame, page: int = 100, run_id: str | None = None) -> DataFrame:
    """J3 with all children: one row per run and page, with the run, and its failures and actions of that page as
    lists of whole rows by id. A list holds ``page`` children at most, however many a run has (children are
    numbered by rows, so a run with very many is spread over tasks); a run without any has one page of empty lists.
    With ``run_id``, of that run only; an unknown run gives no row."""
    if run_id is not None:
        runs, failure_logs, actions = (df.where(F.col("run_id") == F.lit(str(run_id))) for df in (runs, failure_logs, actions))

    def paged(children: DataFrame, name: str) -> DataFrame:
        n = running(children, ["run_id"], ["id"], sums={"_n": F.lit(1).cast("bigint")})
        row = F.struct("id", *[c for c in children.columns if c != "id"])
        return n.groupBy("run_id", F.floor(F.col("_n") / page).alias("page")).agg(F.array_sort(F.collect_list(row)).alias(name))

    f, a = paged(failure_logs, "failures"), paged(actions, "healing_actions")
    numbers = f.select("run_id", "page").unionByName(a.select("run_id", "page")).unionByName(
        runs.select("run_id", F.lit(0).cast("bigint").alias("page"))).distinct()
    j = runs.join(numbers, "run_id").join(f, ["run_id", "page"], "left").join(a, ["run_id", "page"], "left")
    none = lambda name, df: F.coalesce(name, F.array().cast(df.schema[name].dataType))
    return j.select(*RUN_COLUMNS, "page", none("failures", f).alias("failures"), none("healing_actions", a).alias("healing_actions"))


def unhealed_failures(runs: DataFrame, actions: DataFrame) -> DataFrame:
    """Failed runs with no healing action (anti join)."""
    failed = runs.filter(F.col("conclusion") == "failure")
    return failed.join(actions.select("run_id"), "run_id", "left_anti").select("run_id", "repo", "created_at")


def runs_with_action(runs: DataFrame, actions: DataFrame, successful: bool = False) -> DataFrame:
    """Runs for which an action (a successful one) exists (semi join)."""
    a = actions.filter(F.col("success")) if successful else actions
    return runs.join(a.select("run_id"), "run_id", "left_semi").select("run_id", "status", "conclusion")


def orphan_check(runs: DataFrame, failure_logs: DataFrame, actions: DataFrame) -> DataFrame:
    """Child rows whose run is not in ``runs`` (the foreign key the SQL schema declares)."""
    ids = runs.select("run_id")
    f = failure_logs.join(ids, "run_id", "left_anti").select(F.lit("failure_logs").alias("child"), "id", "run_id")
    a = actions.join(ids, "run_id", "left_anti").select(F.lit("healing_actions").alias("child"), "id", "run_id")
    return f.unionByName(a)


# ---------------------------------------------------------------------------------------------
# T1, T2
# ---------------------------------------------------------------------------------------------

def recent_failures(runs: DataFrame, limit: int = 10) -> DataFrame:
    """Newest completed failed runs (TakeOrderedAndProject: per-task top-k, then merge)."""
    f = runs.filter((F.col("status") == "completed") & (F.col("conclusion") == "failure"))
    return f.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select(*RUN_COLUMNS)


def metric_series(metrics: DataFrame, metric_name: str, hours: int = 24, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """One metric in the last ``hours`` before ``as_of``, ascending time."""
    f = metrics.filter((F.col("metric_name") == metric_name) & (F.col("timestamp") >= cutoff(as_of, hours=hours)))
    return f.orderBy("timestamp", "id")


# ---------------------------------------------------------------------------------------------
# W3, W4
# ---------------------------------------------------------------------------------------------

def consecutive_dedupe(polled: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Drop an observation whose id equals the immediately previous observed id.

    Observations without an id (null or 0, the poll loop's falsy ids) are skipped and do not
    reset the comparison. ``keys`` partitions the sequence (e.g. by repo); without keys the
    whole table is one sequence, still computed chunk-parallel.
    """
    seen = polled.filter(F.col("id").isNotNull() & (F.col("id") != 0))
    lagged = lag_by(seen, list(keys), "seq", "id", "prev_id")
    return lagged.filter(F.col("prev_id").isNull() | (F.col("prev_id") != F.col("id"))) \
                 .select("seq", "id", "name", "status", "conclusion")


def first_observation(polled: DataFrame, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """Keep the first observation of each key (safe monitor: only null ids are dropped).

    ``key=("id", "effective_status")`` also processes a run again once its status changes
    (a run first seen in progress is looked at again when it has concluded).
    """
    seen = polled.filter(F.col("id").isNotNull())
    if "effective_status" in key and "effective_status" not in polled.columns:
        seen = seen.withColumn("effective_status", F.coalesce("conclusion", "status", F.lit("unknown")))
    cols = ["seq", "id", "name", "status", "conclusion"]
    g = seen.groupBy(*key).agg(F.min_by(F.struct(*cols), F.col("seq")).alias("o"))
    return g.select(*[F.col(f"o.{c}").alias(c) for c in cols])


# ---------------------------------------------------------------------------------------------
# S10 retention
# ---------------------------------------------------------------------------------------------

def retention(runs: DataFrame, failure_logs: DataFrame, actions: DataFrame, metrics: DataFrame,
              as_of: str = DEFAULT_AS_OF, days: int = 90) -> dict[str, DataFrame]:
    """Keep-sets after deleting data older than ``days``.

    Metrics go by their own timestamp; runs by created_at; failure logs and actions go with
    their run (by run_id, not their own time). Null times and orphans stay.
    """
    cut = cutoff(as_of, days=days)
    old = runs.filter(F.col("created_at") < cut).select("run_id")
    return {
        "runs": runs.filter(~(F.col("created_at") < cut) | F.col("created_at").isNull()),
        "failure_logs": failure_logs.join(old, "run_id", "left_anti"),
        "healing_actions": actions.join(old, "run_id", "left_anti"),
        "metrics": metrics.filter(~(F.col("timestamp") < cut) | F.col("timestamp").isNull()),
    }


# ---------------------------------------------------------------------------------------------
# S13 row serialisation
# ---------------------------------------------------------------------------------------------

def iso_ts(c: Column) -> Column:
    """Python ``isoformat()`` of a zone-less timestamp: microseconds only when non-zero."""
    micros = F.unix_micros(c.cast("timestamp")) % 1000000
    return F.when(c.isNull(), F.lit(None).cast("string")) \
            .when(micros == 0, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")) \
            .otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def as_json(row: dict[str, Column]) -> Column:
    """One JSON object, nulls kept as null."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in row.items()]), {"ignoreNullFields": "false"})


#: Columns of the four tables in the order they are serialised.
SERIALIZED = {
    "runs": RUN_COLUMNS,
    "failure_logs": ["id", "run_id", "error_type", "error_message", "stack_trace", "severity", "created_at"],
    "healing_actions": ["id", "run_id", "action_type", "success", "details", "changes_made", "created_at"],
    "metrics": ["id", "run_id", "metric_name", "metric_value", "timestamp"],
}


def serialized(table: str, column: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """A row's fields as they are serialised: ISO-8601 times, an action's details as JSON and its changes as a list."""
    shape = {"details": lambda c: F.try_parse_json(c), "changes_made": lambda c: F.coalesce(c, F.array().cast("array<string>"))}
    return {name: iso_ts(column(name)) if name.endswith("_at") or name == "timestamp" else shape.get(name, lambda c: c)(column(name))
            for name in SERIALIZED[table]}


def serialize_rows(df: DataFrame, table: str) -> DataFrame:
    """One JSON object per row of one of the four tables."""
    return df.select("id", as_json(serialized(table)).alias("json"))


def serialize_runs(runs: DataFrame) -> DataFrame:
    """S13 for runs."""
    return serialize_rows(runs, "runs")


def get_row(df: DataFrame, key: str, value) -> DataFrame:
    """The row of any of the four tables with this key; the filter is pushed to its scan."""
    return df.filter(F.col(key) == F.lit(value))
