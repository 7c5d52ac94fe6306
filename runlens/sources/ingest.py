"""Ingest of webhook deliveries and polled run lists, and the append sinks (S1, S2, S4, S6-S8, 2.7).

JSON is parsed with ``from_json`` against explicit schemas (no inference, no Python), in
PERMISSIVE mode: malformed input becomes null and is filtered or counted, never an exception.
Appends write to a table folder under the shared checkpoint location and are read back, so a
lost executor only re-runs its own write task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import checkpoint_path

WORKFLOW_RUN = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("conclusion", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("head_branch", T.StringType()),
    T.StructField("head_sha", T.StringType()),
])
WEBHOOK = T.StructType([
    T.StructField("action", T.StringType()),
    T.StructField("ref", T.StringType()),
    T.StructField("workflow_run", WORKFLOW_RUN),
    T.StructField("repository", T.StructType([T.StructField("full_name", T.StringType())])),
])
# Actions that store a run; any other action is acknowledged and ignored.
ACCEPTED_ACTIONS = ["completed", "failed"]


def utc_timestamp(text: Column) -> Column:
    """A timestamp text as UTC without zone: an offset (``Z``, ``+02:00``) is applied, none means
    UTC; text that is no timestamp is null, never an error. The session's zone plays no part."""
    zoned = F.regexp_like(text, F.lit(r"(Z|[+-]\d{2}:?\d{2})$"))
    moment = F.when(zoned, F.try_to_timestamp(text)).cast("timestamp_ntz")
    moment = F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment)
    return F.when(zoned, moment).otherwise(text.try_cast("timestamp_ntz"))


def webhook_ingest(webhooks: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per delivery: ``received`` with the typed run fields, or ``ignored``."""
    p = webhooks.withColumn("_p", F.from_json(F.col(payload), WEBHOOK, {"mode": "PERMISSIVE"}))
    ok = F.col("_p.action").isin(ACCEPTED_ACTIONS)
    w = lambda c: F.when(ok, c)
    ts = utc_timestamp
    return p.select(
        "delivery_id", F.col("_p.action").alias("action"),
        F.when(ok, F.lit("received")).otherwise(F.lit("ignored")).alias("outcome"),
        w(F.col("_p.workflow_run.id").cast("string")).alias("run_id"),
        w(F.col("_p.repository.full_name")).alias("repo"),
        w(F.col("_p.workflow_run.status")).alias("status"),
        w(F.col("_p.workflow_run.conclusion")).alias("conclusion"),
        w(ts(F.col("_p.workflow_run.created_at"))).alias("started_at"),
        w(ts(F.col("_p.workflow_run.updated_at"))).alias("completed_at"),
    )


def webhook_route(webhooks: DataFrame) -> DataFrame:
    """Type-specific fields per delivery; fields that a type does not carry are null, unknown
    types keep the raw payload. Nested objects stay JSON text."""
    et, pl = F.col("event_type"), F.col("payload")
    g = lambda path: F.get_json_object(pl, path)
    is_ = lambda *ts: et.isin(list(ts))
    return webhooks.select(
        "delivery_id", et.alias("event"),
        F.when(is_("workflow_run", "pull_request"), g("$.action")).alias("action"),
        F.when(is_("workflow_run"), g("$.workflow_run")).alias("workflow_run"),
        F.when(is_("pull_request"), g("$.pull_request")).alias("pull_request"),
        F.when(is_("push"), g("$.ref")).alias("ref"),
        F.when(is_("push"), g("$.commits")).alias("commits"),
        F.when(is_("push"), g("$.pusher")).alias("pusher"),
        F.when(is_("workflow_run", "push", "pull_request"), g("$.repository")).alias("repository"),
        F.when(~is_("workflow_run", "push", "pull_request"), pl).alias("payload"),
    )


POLL = T.StructType([T.StructField("workflow_runs", T.ArrayType(T.StringType()))])
POLLED_RUN = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("conclusion", T.StringType()),
])


#: ``workflow_runs`` with a value that counts as none.
EMPTY_RUNS = r'"workflow_runs"\s*:\s*(false|-?0(\.0+)?([eE][+-]?\d+)?|""|\{\s*\})\s*[,}]'


def _poll_parsed(responses: DataFrame, raw: str) -> DataFrame:
    # A JSON string field keeps an element's raw text, so each list element is checked on its own.
    return responses.withColumn("_p", F.from_json(F.col(raw), POLL, {"mode": "PERMISSIVE"}))


def poll_ingest(responses: DataFrame, raw: str = "raw", drop_falsy_ids: bool = False) -> DataFrame:
    """Valid runs of every poll response. A response must be an object whose
    ``workflow_runs`` is a list; a run must be an object with an id (with ``drop_falsy_ids`` an id
    of 0 is dropped too, as the first poll loop does).

    Ids are integers (as the CI API returns them); a non-integral id is treated as missing.
    Spark's JSON reader stops after the first complete value, so text trailing a valid object
    is ignored rather than making the response invalid.
    """
    p = _poll_parsed(responses, raw).filter(F.col("_p.workflow_runs").isNotNull())
    e = p.select("poll_id", F.posexplode("_p.workflow_runs").alias("idx", "_r"))
    r = e.select("poll_id", "idx", F.from_json("_r", POLLED_RUN, {"mode": "PERMISSIVE"}).alias("run"))
    ok = F.col("run.id").isNotNull()
    if drop_falsy_ids:
        ok = ok & (F.col("run.id") != 0)
    return r.filter(ok).select("poll_id", "idx", "run.id", "run.name", "run.status", "run.conclusion")


def poll_ingest_summary(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """S4 counts: responses, malformed responses, runs kept, runs dropped. An object without
    ``workflow_runs``, or with an empty value there (null, false, 0, "", {}), is a valid answer without runs."""
    p = _poll_parsed(responses, raw)
    listed = F.get_json_object(F.col(raw), "$.workflow_runs").isNotNull()
    empty = F.from_json(F.col(raw), "map<string,string>").isNotNull() & (~listed | F.col(raw).rlike(EMPTY_RUNS))
    runs = F.coalesce(F.col("_p.workflow_runs"), F.array().cast("array<string>"))
    kept = F.size(F.filter(runs, lambda r: F.from_json(r, POLLED_RUN)["id"].isNotNull()))
    bad = F.col("_p.workflow_runs").isNull() & ~F.coalesce(empty, F.lit(False))
    g = p.select(bad.alias("bad"), F.size(runs).alias("n"), kept.alias("k"))
    return g.agg(
        F.count(F.lit(1)).alias("responses"), F.count_if("bad").alias("malformed_responses"),
        F.sum("k").cast("bigint").alias("runs_kept"), (F.sum("n") - F.sum("k")).cast("bigint").alias("runs_dropped"))


def observed_runs(webhook_rows: DataFrame, polled: DataFrame) -> DataFrame:
    """2.7: runs seen by either path, each once (both paths feed the same counters)."""
    w = webhook_rows.filter(F.col("outcome") == "received").select("run_id")
    p = polled.select(F.col("id").cast("string").alias("run_id"))
    return w.unionByName(p).filter(F.col("run_id").isNotNull()).dropDuplicates(["run_id"])


# ---------------------------------------------------------------------------------------------
# Append sinks
# ---------------------------------------------------------------------------------------------

def table_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table under the shared checkpoint location."""
    return checkpoint_path(spark, f"tables/{name}-{uuid.uuid4().hex}")


def append(df: DataFrame, path: str) -> DataFrame:
    """Append ``df`` to the parquet table at ``path`` and return the table as read back."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def failure_log_appends(analysis: DataFrame, severity: str | None = None) -> DataFrame:
    """S6 rows: the analysed failure as stored; severity defaults to ``medium``."""
    return analysis.select(
        F.col("log_id").alias("id"), "run_id", "error_type", "error_message", "stack_trace",
        F.lit(severity or "medium").alias("severity"), "created_at")


def healing_action_appends(actions: DataFrame) -> DataFrame:
    """S7 rows: ``changes_made`` defaults to an empty list."""
    changes = F.col("changes_made") if "changes_made" in actions.columns else F.lit(None).cast("array<string>")
    return actions.select("id", "run_id", "action_type", "success", "details",
                          F.coalesce(changes, F.array().cast("array<string>")).alias("changes_made"), "created_at")


def metric_appends(metrics: DataFrame, as_of: str) -> DataFrame:
    """S8 rows: (metric_name, metric_value, run_id?) with the timestamp defaulting to ``as_of``."""
    return metrics.select("id", "run_id", "metric_name", F.col("metric_value").cast("double").alias("metric_value"),
                          F.coalesce(F.col("timestamp"), F.lit(as_of).cast("timestamp_ntz")).alias("timestamp"))
