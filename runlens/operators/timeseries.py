"""Dashboard time-series queries over long sample tables.

Samples are rows ``(seq, ts, <labels>, value)``; a series is one label combination.
Definitions (documented choices, not Prometheus' extrapolating ones): the increase of a counter
over ``(t - w, t]`` is the sum of reset-corrected deltas between consecutive samples inside the
window; the first sample inside a window is the baseline and counts 0; a drop in value is a
reset and counts the new value. ``rate = increase / w``. No extrapolation to window edges.

Windowed rates take the lag inside each (series, window) group, since a window's first sample is
its baseline. A hot series is then split into one group per window, and the aggregate reuses that
partitioning. The single-window increase (Q1) uses the chunk-parallel lag (``scan.lag_by``),
so a hot series inside one long window is still split across tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runs import cutoff, ts_lit
from .scan import lag_by

SERIES = ["job", "address"]
# Fixed value: the scrape target relabelling (address -> instance, drop the port).
INSTANCE_PATTERN = r"^([^:]+)(:[0-9]+)?$"
STALENESS_SECONDS = 300


def instance_of(address: Column) -> Column:
    """Relabel an address to an instance (anchored; no match keeps the address)."""
    return F.regexp_replace(address, INSTANCE_PATTERN, "$1")


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def with_deltas(samples: DataFrame, series: list[str] = SERIES) -> DataFrame:
    """Per sample: the reset-corrected delta to the series' previous sample (null for the first)."""
    lagged = lag_by(samples, series, "seq", "value", "_prev")
    d = F.when(F.col("_prev").isNull(), F.lit(None).cast("double")) \
         .when(F.col("value") < F.col("_prev"), F.col("value")) \
         .otherwise(F.col("value") - F.col("_prev"))
    return lagged.withColumn("delta", d).drop("_prev")


def _reset_delta(v: Column, prev: Column) -> Column:
    return F.when(prev.isNull(), F.lit(None).cast("double")).when(v < prev, v).otherwise(v - prev)


def counter_increase(samples: DataFrame, as_of: str, hours: int = 24, series: list[str] = SERIES,
                     bucket_seconds: int = 3600) -> DataFrame:
    """Q1: ``increase(counter[hours])`` per series at ``as_of`` (sum over series = the panel).

    Exact and split: the window is cut into buckets; inside a bucket the lag is local, and the
    step between consecutive non-empty buckets comes from a per-bucket (first, last) summary.
    Only sums are needed, so nothing is joined back to the samples, and a hot series is spread
    over its buckets.
    """
    win = samples.filter((F.col("ts") > cutoff(as_of, hours=hours)) & (F.col("ts") <= ts_lit(as_of)))
    b = win.withColumn("_b", F.floor(_micros(F.col("ts")) / F.lit(bucket_seconds * 1_000_000)).cast("bigint"))
    prev = F.lag("value").over(Window.partitionBy(*series, "_b").orderBy("seq"))
    per = b.withColumn("_d", _reset_delta(F.col("value"), prev)).groupBy(*series, "_b").agg(
        F.coalesce(F.sum("_d"), F.lit(0.0)).alias("_within"),
        F.min_by("value", F.col("seq")).alias("_first"), F.max_by("value", F.col("seq")).alias("_last"))
    step = _reset_delta(F.col("_first"), F.lag("_last").over(Window.partitionBy(*series).orderBy("_b")))
    per = per.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return per.groupBy(*series).agg((F.sum("_within") + F.sum("_step")).alias("increase"))


def _window_deltas(samples: DataFrame, window_seconds: int, series: list[str]) -> DataFrame:
    """Samples with their window end ``_end`` (``(t - w, t]`` on the w grid) and the
    reset-corrected delta to the previous sample *of the same window* (null for the first: it is
    the window's baseline). Partitioned by series and window, so a hot series is split into as
    many groups as it has windows, and the aggregate that follows reuses the partitioning."""
    w = window_seconds * 1_000_000
    m = _micros(F.col("ts"))
    d = samples.withColumn("_m", m).withColumn("_end", (F.ceil(m / F.lit(w)) * F.lit(w)).cast("bigint"))
    prev = F.lag("value").over(Window.partitionBy(*series, "_end").orderBy("seq"))
    delta = F.when(prev.isNull(), F.lit(None).cast("double")).when(F.col("value") < prev, F.col("value")) \
             .otherwise(F.col("value") - prev)
    return d.withColumn("delta", delta)


def windowed_increase(samples: DataFrame, window_seconds: int, series: list[str] = SERIES) -> DataFrame:
    """Increase per series and tumbling window ``(t - w, t]`` (t on the w grid)."""
    d = _window_deltas(samples, window_seconds, series)
    g = d.groupBy(*series, "_end").agg(F.coalesce(F.sum("delta"), F.lit(0.0)).alias("increase"),
                                       F.count(F.lit(1)).alias("samples"))
    return g.select(*series, F.timestamp_micros("_end").cast("timestamp_ntz").alias("window_end"), "samples",
                    "increase")


def extrapolated_increase(samples: DataFrame, window_seconds: int, series: list[str] = SERIES) -> DataFrame:
    """Q1/Q2 with Prometheus' edge extrapolation, per series and tumbling window ``(t - w, t]``.

    From the window's own samples (all aggregates): observed increase (reset-corrected), first
    and last sample time, first value and count. The observed span is stretched to the window
    edges when the gap to an edge is under 1.1 x the average sample spacing (else by half a
    spacing), and not further back than the counter's extrapolated zero. Windows with fewer than
    two samples give no result.
    """
    w = window_seconds * 1_000_000
    d = _window_deltas(samples, window_seconds, series)
    g = d.groupBy(*series, "_end").agg(
        F.coalesce(F.sum("delta"), F.lit(0.0)).alias("inc"),
        F.min_by("_m", F.col("seq")).alias("t0"), F.max_by("_m", F.col("seq")).alias("t1"),
        F.min_by("value", F.col("seq")).alias("v0"), F.count(F.lit(1)).alias("n"))
    g = g.filter(F.col("n") >= 2)
    sampled = (F.col("t1") - F.col("t0")) / 1e6
    to_start = (F.col("t0") - (F.col("_end") - F.lit(w))) / 1e6
    to_end = (F.col("_end") - F.col("t1")) / 1e6
    avg_gap = sampled / (F.col("n") - 1)
    to_zero = sampled * (F.col("v0") / F.col("inc"))
    to_start = F.when((F.col("inc") > 0) & (F.col("v0") >= 0) & (to_zero < to_start), to_zero).otherwise(to_start)
    thr = avg_gap * 1.1
    ext = (sampled + F.when(to_start < thr, to_start).otherwise(avg_gap / 2)
           + F.when(to_end < thr, to_end).otherwise(avg_gap / 2))
    inc = F.when(sampled > 0, F.col("inc") * ext / sampled).otherwise(F.lit(None).cast("double"))
    return g.select(*series, F.timestamp_micros("_end").cast("timestamp_ntz").alias("window_end"),
                    F.col("n").alias("samples"), inc.alias("increase"),
                    (inc / float(window_seconds)).alias("rate"))


def counter_rate(samples: DataFrame, window_seconds: int = 300, series: list[str] = SERIES,
                 extrapolate: bool = False) -> DataFrame:
    """Q2: ``rate(counter[w])`` per series at every window end. ``extrapolate=True`` stretches the
    observed increase to the window edges as Prometheus does (``extrapolated_increase``)."""
    if extrapolate:
        return extrapolated_increase(samples, window_seconds, series)
    inc = windowed_increase(samples, window_seconds, series)
    return inc.withColumn("rate", F.col("increase") / float(window_seconds))


def rate_by_label(samples: DataFrame, label: str = "job", window_seconds: int = 300,
                  extrapolate: bool = False) -> DataFrame:
    """Q3: ``sum by (label) (rate(counter[w]))`` per window end."""
    r = counter_rate(samples, window_seconds, extrapolate=extrapolate)
    return r.groupBy(label, "window_end").agg(F.sum("rate").alias("rate"))


def histogram_quantile(buckets: DataFrame, q: float, group: list[str] | None = None,
                       le: str = "le", count: str = "cum_count") -> DataFrame:
    """Q4: quantile ``q`` from cumulative buckets per group, with linear interpolation inside
    the bucket; the lowest bucket starts at 0; a quantile in the ``+Inf`` bucket returns the
    highest finite bound; a group with no observations gives null.

    The bucket set per group is fixed by the metric (a handful of bounds), so the window over
    ``le`` sees a bounded number of rows per group.
    """
    group = group or ["day"]
    w = Window.partitionBy(*group).orderBy(le)
    b = buckets.select(*group, F.col(le).alias("le"), F.col(count).alias("c")) \
        .withColumn("prev_le", F.lag("le").over(w)).withColumn("prev_c", F.lag("c").over(w))
    tot = b.groupBy(*group).agg(F.max_by("c", "le").alias("total"),
                                F.max(F.when(~F.isnan("le") & (F.col("le") != float("inf")), F.col("le"))).alias("max_finite"))
    j = b.join(tot, group, "inner").withColumn("rank", F.lit(q) * F.col("total"))
    hit = j.filter(F.col("c") >= F.col("rank")).groupBy(*group).agg(
        F.min_by(F.struct("le", "prev_le", "c", "prev_c", "total", "max_finite", "rank"), F.col("le")).alias("h"))
    h = lambda c: F.col(f"h.{c}")
    start = F.coalesce(h("prev_le"), F.lit(0.0))
    cstart = F.coalesce(h("prev_c"), F.lit(0.0))
    interp = start + (h("le") - start) * (h("rank") - cstart) / (h("c") - cstart)
    val = (F.when(h("total") <= 0, F.lit(None).cast("double"))
            .when(h("le") == float("inf"), h("max_finite"))
            .when(h("c") == cstart, h("le"))
            .otherwise(interp))
    return hit.select(*group, val.alias("quantile"))


def legend_calcs(samples: DataFrame, series: list[str] = SERIES) -> DataFrame:
    """Q5: per series last / min / max over the range."""
    return samples.groupBy(*series).agg(F.max_by("value", "seq").alias("last"), F.min("value").alias("min"),
                                        F.max("value").alias("max"))


def last_not_null(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Q6: the newest non-null value per key."""
    nn = df.filter(F.col(value).isNotNull())
    return nn.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(*order)).alias("last_value"))


def latest_per_series(samples: DataFrame, as_of: str | None = None, series: list[str] = SERIES) -> DataFrame:
    s = samples if as_of is None else samples.filter(F.col("ts") <= ts_lit(as_of))
    return s.groupBy(*series).agg(F.max_by(F.struct("value", "ts"), F.col("seq")).alias("l")) \
            .select(*series, F.col("l.value").alias("value"), F.col("l.ts").alias("ts"))


def requests_by_instance(samples: DataFrame, as_of: str | None = None) -> DataFrame:
    """``sum(counter) by (instance)`` over the latest sample of every series."""
    l = latest_per_series(samples, as_of)
    return l.groupBy(instance_of(F.col("address")).alias("instance")).agg(F.sum("value").alias("value"))


def ratio_of_sums(samples: DataFrame, label: str, match: str, as_of: str | None = None) -> DataFrame:
    """Q7: ``sum(counter{label=match}) / sum(counter) * 100`` over the latest samples; null while all
    counters are 0."""
    l = latest_per_series(samples, as_of)
    part = F.sum(F.when(F.col(label) == match, F.col("value")).otherwise(0.0))
    return l.agg((F.try_divide(part, F.sum("value")) * 100).alias("ratio"))


def up_status(samples: DataFrame, as_of: str, staleness_seconds: int = STALENESS_SECONDS) -> DataFrame:
    """``up`` per target (job, instance): 1 when its latest sample at ``as_of`` is no older
    than the staleness period, else 0."""
    s = samples.filter(F.col("ts") <= ts_lit(as_of)).withColumn("instance", instance_of(F.col("address")))
    g = s.groupBy("job", "instance").agg(F.max("ts").alias("last_seen"))
    age = (_micros(ts_lit(as_of)) - _micros(F.col("last_seen"))) / 1e6
    return g.withColumn("up", F.when(age <= staleness_seconds, 1).otherwise(0))
