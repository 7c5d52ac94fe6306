"""Log classification operators over a table of logs.

All work is column expressions evaluated once per row inside whole-stage codegen; the only
shuffles are the final per-category aggregations, which combine map-side first (at most 11
groups), so a hot category cannot overload one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify as C


def _with_index(logs: DataFrame, text: str, index: Column) -> DataFrame:
    """Add ``_text`` and the first-match index ``_k``.

    ``_k`` comes out of a one-row ``inline`` generator rather than a plain projection: Catalyst
    does not push filters on generator output below the generator, so a later filter such as
    ``error_type = 'x'`` is evaluated on the computed index instead of being rewritten into a
    second copy of the whole regex chain (which doubled the work and exceeded the 64 KB method
    limit of generated code).
    """
    t = logs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    return t.select("*", F.inline(F.array(F.struct(index.alias("_k")))))


def analyze_failure(logs: DataFrame, text: str = "logs") -> DataFrame:
    """the engine's analysis per log row (error_type, message, fixable, package, test, trace, severity)."""
    base = [c for c in logs.columns if c != text]
    t = F.col("_text")
    a = _with_index(logs, text, C.engine_index(t)).select(*base, *C.engine_fields(t, F.col("_k")))
    return a.select(
        *base, "error_type", "error_message",
        F.col("error_type").isin(C.HEALABLE_TYPES).alias("fixable"),
        "missing_package", "test_name", "stack_trace",
        C.severity_of(F.col("error_type")).alias("severity"),
    )


def failure_log_rows(job_logs: DataFrame, severity: str | None = None) -> DataFrame:
    """S6 applied to F1: rows as stored in ``failure_logs``.

    The stored severity is the append default ``medium`` unless ``severity`` is given; the
    monitored service never passes the analysed severity to the append.
    """
    a = analyze_failure(job_logs)
    return a.select(
        F.col("log_id").alias("id"), "run_id", "error_type", "error_message", "stack_trace",
        F.lit(severity or "medium").alias("severity"), "created_at",
    )


def identify_pattern(logs: DataFrame, text: str = "logs") -> DataFrame:
    """analyzer taxonomy per log row."""
    base = [c for c in logs.columns if c != text]
    t = F.col("_text")
    p = _with_index(logs, text, C.analyzer_index(t)).select(*base, *C.analyzer_fields(t, F.col("_k")))
    return p.withColumn("difficulty", C.difficulty_of(F.col("pattern_type"), unknown="hard"))


def stack_traces(logs: DataFrame, text: str = "logs") -> DataFrame:
    """stack trace per log, null when there is none."""
    return logs.select(*[c for c in logs.columns if c != text],
                       C.stack_trace_of(F.col(text)).alias("stack_trace"))


def packages(logs: DataFrame, text: str = "logs") -> DataFrame:
    """package name from dependency errors (case-sensitive), null when none."""
    return logs.select(*[c for c in logs.columns if c != text],
                       C.extract_package(F.col(text)).alias("package"))


def test_names(logs: DataFrame, text: str = "logs") -> DataFrame:
    """failing test name or ``unknown_test``."""
    return logs.select(*[c for c in logs.columns if c != text],
                       C.extract_test_name(F.col(text)).alias("test_name"))


def severities(analysis: DataFrame) -> DataFrame:
    """severity of each analysed error type."""
    return analysis.select("log_id", "error_type", C.severity_of(F.col("error_type")).alias("severity"))


def pattern_dim(spark: SparkSession) -> DataFrame:
    """The ten-row category dimension (difficulty, strategy, fix seconds, auto-healable)."""
    return spark.createDataFrame(
        [(c, d, s, int(sec), bool(auto)) for c, d, s, sec, auto in C.PATTERN_DIM],
        "pattern_type string, difficulty string, strategy string, fix_seconds int, auto_healable boolean",
    )


def strategy_lookup(patterns: DataFrame) -> DataFrame:
    """Join each classified log to its strategy; unknown -> manual_intervention/unknown/0/false.

    The dimension has a fixed ten rows, so it is broadcast: no shuffle of the log side.
    """
    dim = F.broadcast(pattern_dim(patterns.sparkSession).drop("difficulty"))
    j = patterns.drop("difficulty").join(dim, "pattern_type", "left")
    return j.select(
        "log_id", "pattern_type",
        F.coalesce("strategy", F.lit("manual_intervention")).alias("strategy"),
        C.difficulty_of(F.col("pattern_type"), unknown="unknown").alias("difficulty"),
        F.coalesce("fix_seconds", F.lit(0)).alias("fix_seconds"),
        F.coalesce("auto_healable", F.lit(False)).alias("auto_healable"),
    )


def pattern_batch_stats(patterns: DataFrame) -> DataFrame:
    """A3: count and percentage per category; difficulty ``unknown`` for the unknown category."""
    g = patterns.groupBy("pattern_type").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # over <= 11 grouped rows
    return g.select(
        "pattern_type", "count",
        (F.col("count") / total * 100).alias("percentage"),
        total.alias("total_failures"),
        C.difficulty_of(F.col("pattern_type"), unknown="unknown").alias("difficulty"),
    )


def most_common_patterns(patterns: DataFrame, k: int = 5, order_col: str = "log_id") -> DataFrame:
    """Top-k categories by count; ties keep first appearance (smallest ``order_col``)."""
    g = patterns.groupBy("pattern_type").agg(F.count(F.lit(1)).alias("count"),
                                             F.min(order_col).alias("first_seen"))
    w = Window.partitionBy().orderBy(F.desc("count"), F.asc("first_seen"))
    return (g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("rank", "pattern_type", "count"))


def failure_type_distribution(failure_logs: DataFrame) -> DataFrame:
    """A10: failures per error type with percent of all failures (donut panel)."""
    g = failure_logs.groupBy("error_type").agg(F.count(F.lit(1)).alias("failures"))
    total = F.sum("failures").over(Window.partitionBy())  # over the grouped rows only
    return g.select("error_type", "failures", (F.col("failures") / total * 100).alias("percent"))
