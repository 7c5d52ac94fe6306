"""CI job/step analytics: test-step counts per run, flaky tests, assembled job logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLAKY_MIN_RESULTS = 5
FLAKY_LOW, FLAKY_HIGH = 0.20, 0.80


def nest_steps(steps: DataFrame) -> DataFrame:
    """Flat step rows -> one row per run with ``jobs: array<struct<name, conclusion, steps>>``.

    The nested form of the API. A run's jobs and steps are bounded by its workflow definition.
    """
    jobs = steps.groupBy("run_id", "job_name").agg(
        F.first("job_conclusion").alias("conclusion"),
        F.array_sort(F.collect_list(F.struct("step_no", F.col("step_name").alias("name"), "conclusion"))).alias("steps"))
    return jobs.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("job_name").alias("name"), "conclusion", "steps"))).alias("jobs"))


def flatten_jobs(nested: DataFrame) -> DataFrame:
    """Nested jobs -> flat step rows (``explode`` twice)."""
    j = nested.select("run_id", F.explode("jobs").alias("job"))
    s = j.select("run_id", F.col("job.name").alias("job_name"), F.col("job.conclusion").alias("job_conclusion"),
                 F.explode("job.steps").alias("step"))
    return s.select("run_id", "job_name", "job_conclusion", F.col("step.step_no").alias("step_no"),
                    F.col("step.name").alias("step_name"), F.col("step.conclusion").alias("conclusion"))


def test_results(steps: DataFrame) -> DataFrame:
    """A4: per run, over steps whose lower-cased name contains ``test``: passed / failed / skipped
    (other conclusions ignored) and their total; a run without such steps has zeros. Failed test
    steps as rows: ``failed_test_steps``."""
    test = F.lower("step_name").contains("test")
    g = steps.groupBy("run_id").agg(
        F.count_if(test & (F.col("conclusion") == "success")).alias("passed"),
        F.count_if(test & (F.col("conclusion") == "failure")).alias("failed"),
        F.count_if(test & (F.col("conclusion") == "skipped")).alias("skipped"),
    )
    return g.withColumn("total_tests", F.col("passed") + F.col("failed") + F.col("skipped"))


def failed_test_steps(steps: DataFrame) -> DataFrame:
    """A4 list part: one row per failed test step {name, job}."""
    return steps.filter(F.lower("step_name").contains("test") & (F.col("conclusion") == "failure")) \
                .select("run_id", F.col("step_name").alias("name"), F.col("job_name").alias("job"), "seq")


def flaky_tests(history: DataFrame) -> DataFrame:
    """A5: per test, flaky when it has at least 5 results and a failure rate within [0.2, 0.8]."""
    g = history.groupBy("test_name").agg(F.count(F.lit(1)).alias("runs"),
                                         F.count_if(~F.col("passed")).alias("failures"))
    rate = F.col("failures") / F.col("runs")
    return g.select("test_name", "runs", "failures", rate.alias("failure_rate"),
                    ((F.col("runs") >= FLAKY_MIN_RESULTS) & (rate >= FLAKY_LOW) & (rate <= FLAKY_HIGH)).alias("is_flaky"))


def assemble_logs(steps: DataFrame, url_prefix: str = "https://example.com/runs/") -> DataFrame:
    """the text log of each run: per job a header with its conclusion, per step a name line,
    a status line and a failure marker, then the logs URL; jobs in the order in which they ran (by their first step), steps by number.

    Two aggregation levels: steps -> job text (per run and job), jobs -> run text. Only the
    pieces of one run meet in one group; a run's size is bounded by its workflow definition.
    """
    status = F.coalesce(F.col("conclusion"), F.lit("None"))
    piece = F.concat(F.lit("\n--- Step: "), F.col("step_name"), F.lit(" ---\nStatus: "), status,
                     F.when(F.col("conclusion") == "failure", F.lit("\n✗ FAILED")).otherwise(F.lit("")))
    jobs = steps.groupBy("run_id", "job_name").agg(
        F.first("job_conclusion").alias("job_conclusion"), F.min("seq").alias("began"),
        F.array_sort(F.collect_list(F.struct("step_no", piece.alias("piece")))).alias("ps"))
    jobs = jobs.select("run_id", "began", "job_name", F.concat(
        F.lit("\n=== Job: "), F.col("job_name"), F.lit(" (Status: "), F.coalesce("job_conclusion", F.lit("None")),
        F.lit(") ===\n\n"), F.array_join(F.transform("ps", lambda x: x["piece"]), "\n")).alias("text"))
    runs = jobs.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("began", "job_name", "text"))).alias("js"))
    return runs.select("run_id", F.concat(
        F.array_join(F.transform("js", lambda x: x["text"]), "\n"),
        F.lit("\n\nLogs URL: "), F.lit(url_prefix), F.col("run_id"), F.lit("/logs")).alias("logs"))
