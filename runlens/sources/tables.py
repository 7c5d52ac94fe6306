"""Load the driver's parquet tables and the derived input views as Spark DataFrames.

Base tables are registered as temp views under their own names; the derived views of
FIXTURES.md are registered on top with the same SQL text the DuckDB oracles use. The run table
and the failure-log table are not read from a view: they are produced by this library's own
operators (``run_upsert`` over ``run_events`` and ``analyze_failure`` over ``job_logs``), so the
downstream queries run on what the library computes.
"""

from __future__ import annotations

import os
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .views_sql import VIEWS

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_registered: dict[tuple[str, int], tuple[str, set[str]]] = {}


def session_key(spark: SparkSession) -> tuple[str, int]:
    """Identity of a live session: its application id and object id (ids alone can be reused
    after a session is stopped and another one created)."""
    return spark.sparkContext.applicationId, id(spark)


def _deps(sql: str) -> list[str]:
    names = [*BASE_TABLES, *VIEWS]
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Register ``names`` (base tables or derived views) for ``sf_dir`` in this session, with
    what they read, and nothing else. Switching to another folder starts over."""
    key = session_key(spark)
    if key not in _registered or _registered[key][0] != sf_dir:
        _registered[key] = (sf_dir, set())
    done = _registered[key][1]

    def ensure(name: str) -> None:
        if name in done and spark.catalog.tableExists(name):
            return
        if name in BASE_TABLES:
            path = f"{sf_dir}/{name}.parquet"
            if os.path.exists(path) or "://" in sf_dir:
                spark.read.parquet(path).createOrReplaceTempView(name)
        else:
            for d in _deps(VIEWS[name]):
                if d != name:
                    ensure(d)
            if name in SPARK_BUILT:
                SPARK_BUILT[name](spark).createOrReplaceTempView(name)
            else:
                spark.sql(VIEWS[name]).createOrReplaceTempView(name)
        done.add(name)

    for n in names or []:
        ensure(n)


def _counter_samples(spark: SparkSession) -> DataFrame:
    """``counter_samples`` (cumulative per job, host and day, reset each midnight), built with the
    chunk-parallel running sum instead of a window per series and day, so one busy series-day is
    still split across tasks. Same rows as the SQL view text."""
    from pyspark.sql import functions as F

    from ..operators.scan import running_sum_by
    ev = spark.table("events").select(
        F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("job"),
        F.concat(F.lit("host-"), (F.col("user_id") % 4).cast("string"), F.lit(":9100")).alias("address"),
        F.to_date("ts").alias("_day"))
    r = running_sum_by(ev, ["job", "address", "_day"], "seq", {"value": F.lit(1.0)}, include_current=True)
    return r.select("seq", "ts", "job", "address", "value")


def _commit_files(spark: SparkSession) -> DataFrame:
    """``commit_files``: up to four files per commit, as an ``explode`` (no cross join)."""
    from pyspark.sql import functions as F
    ev = spark.table("events")
    ks = F.filter(F.array(*[F.lit(k) for k in range(4)]), lambda k: k < F.col("event_id") % 5)
    e = ev.select(F.md5(F.col("event_id").cast("string")).alias("sha"), F.explode(ks).alias("k"))
    return e.select("sha", F.concat(F.lit("src/f"), F.col("k").cast("string"), F.lit(".py")).alias("path"))


DURATION_BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0, float("inf")]


def _duration_buckets(spark: SparkSession) -> DataFrame:
    """``duration_buckets``: cumulative count per day and bound, as one aggregate per day with a
    ``count_if`` per bound, then unpivoted (no cross join, no row expansion before the shuffle)."""
    from pyspark.sql import functions as F
    m = spark.table("metrics")
    g = m.groupBy(F.to_date("timestamp").alias("day")).agg(
        *[F.count_if(F.col("metric_value") <= F.lit(b)).cast("double").alias(f"c{i}") for i, b in enumerate(DURATION_BOUNDS)])
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"c{i}").alias("cum_count")) for i, b in enumerate(DURATION_BOUNDS)])
    return g.select("day", F.inline(pairs))


def _bucket_samples(spark: SparkSession) -> DataFrame:
    """``bucket_samples``: the cumulative count of every bound at every event, reset each midnight; one running
    sum per bound over the same ordered rows, then unpivoted."""
    from pyspark.sql import functions as F

    from ..operators.scan import running_sum_by
    ev = spark.table("events").select(F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("job"), "value", F.to_date("ts").alias("_day"))
    counts = {f"c{i}": (F.col("value") <= F.lit(b)).cast("double") for i, b in enumerate(DURATION_BOUNDS)}
    r = running_sum_by(ev, ["job", "_day"], "seq", counts, include_current=True)
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"c{i}").alias("value")) for i, b in enumerate(DURATION_BOUNDS)])
    return r.drop("value").select("seq", "ts", "job", F.inline(pairs))


def _repo_files(spark: SparkSession) -> DataFrame:
    """``repo_files``: three files per repository (one missing pytest.ini in five), via explode."""
    from pyspark.sql import functions as F
    r = spark.table("events").select((F.col("user_id") % 20).alias("r")).distinct()
    paths = F.array(F.lit("requirements.txt"), F.lit("pytest.ini"), F.lit(".github/workflows/main.yml"))
    x = r.select("r", F.explode(paths).alias("path")).filter(~((F.col("path") == "pytest.ini") & (F.col("r") % 5 == 4)))
    nl = F.lit("\n")
    content = (F.when(F.col("path") == "requirements.txt",
                      F.concat(F.lit("requests==2.31.0"), nl, F.lit("pkg"), (F.col("r") % 9).cast("string"), nl))
                .when(F.col("path") == "pytest.ini",
                      F.when(F.col("r") % 2 == 0, F.concat(F.lit("[pytest]"), nl, F.lit("timeout = 60"), nl))
                       .otherwise(F.concat(F.lit("[pytest]"), nl)))
                .otherwise(F.when(F.col("r") % 3 == 0, F.concat(F.lit("jobs:"), nl, F.lit("  timeout-minutes: 10"), nl))
                            .otherwise(F.concat(F.lit("jobs: {}"), nl))))
    return x.select(F.concat(F.lit("org/repo-"), F.col("r").cast("string")).alias("repo"), F.lit("main").alias("branch"),
                    "path", content.alias("content"))


# Views whose Spark form is built with DataFrame operators (same rows as the SQL text).
SPARK_BUILT = {"counter_samples": _counter_samples, "commit_files": _commit_files,
               "duration_buckets": _duration_buckets, "bucket_samples": _bucket_samples, "repo_files": _repo_files}


class Tables:
    """Typed access to inputs for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        register(spark, sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS or name in BASE_TABLES:
            register(self.spark, self.sf_dir, [name])
            return self.spark.table(name)
        raise AttributeError(name)

    @cached_property
    def runs(self) -> DataFrame:
        """Run table as produced by the upsert operator (equals the ``pipeline_runs`` view)."""
        from ..operators.runs import run_upsert
        return run_upsert(self.run_events)

    @cached_property
    def failure_logs(self) -> DataFrame:
        """Failure-log table: the engine's analysis of every job log, appended as stored rows."""
        from ..operators.classify_ops import failure_log_rows
        return failure_log_rows(self.job_logs)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)
