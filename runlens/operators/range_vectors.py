"""Range vectors: increase and rate over windows that slide by a step (Q1-Q4 as panels evaluate them).

At each step t the window is ``(t - w, t]``; its increase is the sum of the reset-corrected deltas between
consecutive samples inside it (the first one is the baseline). Steps are on the grid of whole steps since
the epoch; a window without a sample gives no row.

No sample is copied into the windows it belongs to. Samples are folded once into panes of one step: increase
inside the pane, the delta that leads into it, and count. Running totals over the panes then give any window from its first
and its last pane: total(last) - total(first) + inside(first), as the delta into the first pane lies outside. The last
pane of a window is the one its steps were made from; the first one is an as-of lookup. All orders run through
``scan.running``, so a series that holds most of the samples, or a moment that does, is dealt out by rows.
Totals are differences of doubles as large as the counter's whole increase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import ts_lit
from .scan import running
from .timeseries import SERIES


def _pane(time: Column, step: int) -> Column:
    return F.ceil(F.unix_micros(time.cast("timestamp")) / F.lit(step * 1_000_000)).cast("bigint")


def panes(samples: DataFrame, step_seconds: int, series: list[str] = SERIES) -> DataFrame:
    """``samples(seq, ts, *series, value)`` -> one row per series and pane that has samples: ``inside`` (increase between
    its own samples), ``into`` (delta from the sample before it, 0 for a series' first), ``samples``."""
    s = samples.select(*series, "ts", "seq", "value", _pane(F.col("ts"), step_seconds).alias("pane"))
    s = running(s, series, ["ts", "seq"], last={"before": F.struct("value", "pane")})
    delta = F.when(F.col("before").isNull(), 0.0).when(F.col("value") < F.col("before.value"), F.col("value")) \
             .otherwise(F.col("value") - F.col("before.value"))
    same = F.col("before.pane") == F.col("pane")
    return s.groupBy(*series, "pane").agg(
        F.sum(F.when(same, delta).otherwise(0.0)).alias("inside"), F.sum(F.when(same, 0.0).otherwise(delta)).alias("into"),
        F.count(F.lit(1)).alias("samples"))


def increase_over(samples: DataFrame, window_seconds: int, step_seconds: int, series: list[str] = SERIES,
                  start: str | None = None, end: str | None = None) -> DataFrame:
    """``increase(counter[w])`` per series at every step from ``start`` to ``end`` (both included; unbounded when
    None) whose window has a sample: *series, t, samples, increase."""
    if window_seconds % step_seconds:
        raise ValueError("the window must be a whole number of steps")
    n = window_seconds // step_seconds
    if start is not None:
        samples = samples.where(F.col("ts") > ts_lit(start) - F.expr(f"interval {window_seconds + step_seconds} seconds"))
    if end is not None:
        samples = samples.where(F.col("ts") <= ts_lit(end))
    p = panes(samples, step_seconds, series)
    p = running(p, series, ["pane"], sums={"total": F.col("inside") + F.col("into"), "many": F.col("samples")}, include_current=True)
    p = running(p.withColumn("back", -F.col("pane")), series, ["back"], last={"next": F.col("pane")})
    # the steps that have this pane as their last one
    steps = p.withColumn("until", F.least(F.col("next") - 1, F.col("pane") + F.lit(n - 1)))
    since = F.col("pane")
    if start is not None:
        since = F.greatest(since, _pane(ts_lit(start), step_seconds))
    if end is not None:
        steps = steps.withColumn("until", F.least("until", F.floor(F.unix_micros(ts_lit(end).cast("timestamp")) / F.lit(step_seconds * 1_000_000))))
    steps = steps.withColumn("since", since).where("since <= until")
    steps = steps.select(*series, F.explode(F.sequence("since", "until")).alias("t"), "total", "many")
    none = F.lit(None)
    steps = steps.select(*series, (-(F.col("t") - F.lit(n - 1))).alias("back"), F.col("t"), "total", "many",
                         none.cast("struct<total:double,many:bigint>").alias("base"))
    # total and count ahead of a pane's own samples: what a window that begins with it takes off
    base = F.struct((F.col("total") - F.col("inside")).alias("total"), (F.col("many") - F.col("samples")).alias("many"))
    looked = steps.unionByName(p.select(*series, "back", none.cast("bigint").alias("t"), none.cast("double").alias("total"),
                                        none.cast("bigint").alias("many"), base.alias("base")))
    # backwards in time, the pane at the window's first place comes before the step that asks for it
    looked = running(looked.withColumn("asks", F.col("t").isNotNull()), series, ["back", "asks", "t"], last={"first": F.col("base")},
                     include_current=True)
    return looked.where("asks").select(
        *series, F.timestamp_micros(F.col("t") * F.lit(step_seconds * 1_000_000)).cast("timestamp_ntz").alias("t"),
        (F.col("many") - F.col("first.many")).alias("samples"), (F.col("total") - F.col("first.total")).alias("increase"))


def rate_over(samples: DataFrame, window_seconds: int, step_seconds: int, series: list[str] = SERIES, **between) -> DataFrame:
    """``rate(counter[w])`` at every step."""
    r = increase_over(samples, window_seconds, step_seconds, series, **between)
    return r.withColumn("rate", F.col("increase") / F.lit(float(window_seconds)))


def rate_by(samples: DataFrame, label: str, window_seconds: int, step_seconds: int, series: list[str] = SERIES, **between) -> DataFrame:
    """``sum by (label) (rate(counter[w]))`` at every step."""
    return rate_over(samples, window_seconds, step_seconds, series, **between).groupBy(label, "t").agg(F.sum("rate").alias("rate"))


def quantiles_over(buckets: DataFrame, quantiles: dict[str, float], window_seconds: int, step_seconds: int, by: list[str],
                   le: str = "le", **between) -> DataFrame:
    """``histogram_quantile(q, rate(metric_bucket[w]))`` at every step, a column per quantile, in one pass.

    ``buckets(seq, ts, *by, le, value)`` are cumulative counters, one series per bound. The rates of a histogram's
    bounds come together as a list, whose length is the number of bounds of the metric. Rates that fall as the
    bound rises (a bucket was scraped late) are lifted to the one below. Interpolation is linear inside a bucket, the lowest
    begins at 0; in the infinite bucket the highest finite bound is the answer; without observations it is null.
    """
    r = rate_over(buckets, window_seconds, step_seconds, [*by, le], **between)
    h = r.groupBy(*by, "t").agg(F.array_sort(F.collect_list(F.struct(F.col(le).alias("le"), F.col("rate").alias("c")))).alias("b"))
    lifted = F.aggregate("b", F.array().cast("array<struct<le:double,c:double,low:double,below:double>>"), lambda done, x: F.concat(done, F.array(F.struct(
        x["le"].alias("le"), F.greatest(x["c"], F.coalesce(F.try_element_at(done, F.lit(-1))["c"], F.lit(0.0))).alias("c"),
        F.coalesce(F.try_element_at(done, F.lit(-1))["le"], F.lit(0.0)).alias("low"),
        F.coalesce(F.try_element_at(done, F.lit(-1))["c"], F.lit(0.0)).alias("below")))))
    h = h.select(*by, "t", lifted.alias("b")).withColumn("all", F.try_element_at("b", F.lit(-1))["c"])

    def at(q: float) -> Column:
        rank = F.lit(q) * F.col("all")
        x = F.try_element_at(F.filter("b", lambda b: b["c"] >= rank), F.lit(1))
        inside = x["low"] + (x["le"] - x["low"]) * (rank - x["below"]) / (x["c"] - x["below"])
        return F.when(F.col("all") > 0, F.when(x["le"] == float("inf"), x["low"]).when(x["c"] == x["below"], x["le"]).otherwise(inside))

    return h.select(*by, "t", *[at(q).alias(name) for name, q in quantiles.items()])
