"""Healing statistics and dashboard figures computed from the tables.

Global figures are single aggregations: Spark computes partial aggregates in every task and
merges one row per task, so no key can be hot. Where two tables feed one row, they are unioned
into one tagged stream and aggregated once instead of joining two one-row results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import DEFAULT_AS_OF, cutoff

# Savings assumed per successful healing, and dashboard panel thresholds.
MINUTES_SAVED_PER_HEAL = 15
COST_SAVED_PER_HEAL = 1.50
SUCCESS_RATE_THRESHOLDS = [(None, "red"), (70, "yellow"), (80, "green")]
HEALING_TIME_THRESHOLDS = [(None, "green"), (120, "yellow"), (300, "red")]
HOURS_SAVED_THRESHOLDS = [(None, "green"), (50, "yellow"), (100, "orange")]


def _tagged(runs: DataFrame, actions: DataFrame) -> DataFrame:
    r = runs.select(F.lit("run").alias("kind"), "run_id", "conclusion", "created_at",
                    F.lit(None).cast("boolean").alias("success"))
    a = actions.select(F.lit("action").alias("kind"), "run_id", F.lit(None).cast("string").alias("conclusion"),
                       "created_at", "success")
    return r.unionByName(a)


def healing_stats_by_action(runs: DataFrame, actions: DataFrame, as_of: str = DEFAULT_AS_OF,
                            days: int = 30) -> DataFrame:
    """A1: failed runs (by run time) and healing actions (by action time) of the last ``days``."""
    recent = F.col("created_at") >= cutoff(as_of, days=days)
    g = _tagged(runs.filter(recent & (F.col("conclusion") == "failure")), actions.filter(recent)).agg(
        F.count_if(F.col("kind") == "run").alias("total_failures"), F.count_if(F.col("kind") == "action").alias("healing_attempted"),
        F.count_if((F.col("kind") == "action") & F.col("success")).alias("healing_successful"))
    ok, att = F.col("healing_successful"), F.col("healing_attempted")
    return g.select(
        "total_failures", "healing_attempted", "healing_successful",
        F.when(att > 0, F.round(ok / att * 100, 2)).otherwise(F.lit(0.0)).alias("success_rate"),
        (ok * MINUTES_SAVED_PER_HEAL).alias("time_saved"),
        F.round(ok * F.lit(COST_SAVED_PER_HEAL), 2).alias("cost_saved"),
    )


def healing_stats_by_run(runs: DataFrame, actions: DataFrame, as_of: str = DEFAULT_AS_OF,
                         days: int = 30) -> DataFrame:
    """A2: runs of the last ``days``; those failed, those with any action, with a successful one."""
    flags = actions.groupBy("run_id").agg(F.max(F.col("success").cast("int")).alias("ok"))
    r = runs.filter(F.col("created_at") >= cutoff(as_of, days=days)).join(flags, "run_id", "left")
    g = r.agg(
        F.count_if(F.col("conclusion") == "failure").alias("total_failures"),
        F.count_if(F.col("ok").isNotNull()).alias("healing_attempted"),
        F.count_if(F.col("ok") == 1).alias("healing_successful"),
    )
    return g.withColumn("success_rate_percentage",
                        F.round(100.0 * F.col("healing_successful") / F.nullif(F.col("total_failures"), F.lit(0)), 2))


def confusion_matrix(pairs: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """All four cells of the 2x2 confusion matrix as one row."""
    y, p = F.col(label), F.col(prediction)
    return pairs.agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def classifier_metrics(pairs: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class; zero division gives 0."""
    cm = confusion_matrix(pairs, label, prediction)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    m = cm.select(
        "tp", "fp", "fn", "tn",
        F.when(n > 0, (tp + tn) / n).otherwise(0.0).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return m.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def failure_rate(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Share of positive labels in percent."""
    return labelled.agg((F.avg(F.col(label).cast("double")) * 100).alias("failure_rate"),
                        F.count(F.lit(1)).alias("samples"))


def healing_sample_check(samples: DataFrame, label: str = "success", min_samples: int = 50) -> DataFrame:
    """Rows and distinct classes of the healing training set and the decision they imply."""
    g = samples.agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct(F.col(label)).alias("n_classes"))
    return g.withColumn(
        "decision",
        F.when(F.col("n_samples") < min_samples, "skip")
         .when(F.col("n_classes") < 2, "majority_class")
         .otherwise("train"))


def healing_success_rate(actions: DataFrame) -> DataFrame:
    """Successful / all healing actions x 100, all time."""
    return actions.agg((F.avg(F.col("success").cast("double")) * 100).alias("success_rate"),
                       F.count(F.lit(1)).alias("actions"))


def healing_durations(runs: DataFrame, actions: DataFrame) -> DataFrame:
    """Per action: seconds from the run's start to the action (the healing duration series); null when
    the run is unknown."""
    j = actions.join(runs.select("run_id", "started_at"), "run_id", "left")
    micros = F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return j.select("id", "run_id", "created_at", "success", micros.alias("duration_micros"))


def exact_mean_seconds(micros: Column) -> Column:
    """Mean of integer microseconds in seconds: the sum stays an exact long, one division."""
    return F.try_divide(F.sum(micros), F.count(micros)) / 1e6


def avg_healing_time(runs: DataFrame, actions: DataFrame) -> DataFrame:
    """Average healing duration in seconds (integer micros averaged exactly) over the actions that
    have one, and their number."""
    d = healing_durations(runs, actions)
    return d.agg(exact_mean_seconds(F.col("duration_micros")).alias("avg_healing_seconds"),
                 F.count("duration_micros").alias("actions"))


def savings_total(actions: DataFrame) -> DataFrame:
    """Total cost saved (USD) and hours saved from successful healings, all time."""
    ok = actions.agg(F.count_if(F.col("success")).alias("ok"))
    return ok.select(
        F.round(F.col("ok") * F.lit(COST_SAVED_PER_HEAL), 2).alias("cost_saved_usd"),
        (F.col("ok") * MINUTES_SAVED_PER_HEAL / 60.0).alias("hours_saved"),
    )


def pipeline_counters(runs: DataFrame, actions: DataFrame) -> DataFrame:
    """Runs observed, successful runs, healing actions."""
    return _tagged(runs, actions).agg(
        F.count_if(F.col("kind") == "run").alias("pipeline_runs_total"),
        F.count_if((F.col("kind") == "run") & (F.col("conclusion") == "success")).alias("pipeline_success_total"),
        F.count_if(F.col("kind") == "action").alias("healing_actions_total"),
    )


def threshold_color(value: Column, thresholds: list[tuple[float | None, str]]) -> Column:
    """Colour of the highest threshold not above ``value`` (base colour below the first)."""
    out = F.lit(thresholds[0][1])
    for t, colour in thresholds[1:]:
        out = F.when(value >= t, F.lit(colour)).otherwise(out)
    return F.when(value.isNull(), F.lit(None).cast("string")).otherwise(out)


def daily_panel_colors(runs: DataFrame, actions: DataFrame) -> DataFrame:
    """P16 applied per day: success rate, mean healing time and hours saved with their colours."""
    d = healing_durations(runs, actions).withColumn("day", F.date_trunc("day", "created_at"))
    g = d.groupBy("day").agg(
        (F.avg(F.col("success").cast("double")) * 100).alias("success_rate"),
        exact_mean_seconds(F.col("duration_micros")).alias("avg_healing_seconds"),
        (F.count_if(F.col("success")) * MINUTES_SAVED_PER_HEAL / 60.0).alias("hours_saved"),
    )
    return g.select(
        "day", "success_rate", threshold_color(F.col("success_rate"), SUCCESS_RATE_THRESHOLDS).alias("success_color"),
        "avg_healing_seconds", threshold_color(F.col("avg_healing_seconds"), HEALING_TIME_THRESHOLDS).alias("time_color"),
        "hours_saved", threshold_color(F.col("hours_saved"), HOURS_SAVED_THRESHOLDS).alias("hours_color"),
    )
