"""Registered queries: counter increase / rate, label sums, histogram quantiles, reducers, target
health (Q1-Q7, P17, P18, A14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import range_vectors as RV
from ..operators import timeseries as TS
from ..sources.tables import tables
from .registry import register

SERIES_AS_OF = "2024-01-20 00:00:00"
SAS = f"timestamp '{SERIES_AS_OF}'"

# Oracle building blocks: per-sample reset-corrected delta to the previous sample of its series.
DELTAS = """select *, case when prev is null then null when value < prev then value else value - prev end as delta
from (select *, lag(value) over (partition by job, address order by seq) as prev from {src}) x"""


@register("counter_increase", f"""
select job, address, coalesce(sum(delta), 0e0) as increase
from ({DELTAS.format(src=f"(select * from counter_samples where ts > {SAS} - interval 24 hour and ts <= {SAS}) w")}) d
group by job, address""")
def counter_increase(spark, sf):
    return TS.counter_increase(tables(spark, sf).counter_samples, SERIES_AS_OF, hours=24)


WIN = f"""select job, address, make_timestamp(cast(ceil(epoch_us(ts) / 300000000e0) * 300000000 as bigint)) as window_end,
  count(*) as samples, sum(coalesce(delta, 0e0)) - arg_min(coalesce(delta, 0e0), seq) as increase
from ({DELTAS.format(src='counter_samples')}) d group by 1, 2, 3"""


@register("counter_rate", f"select job, address, window_end, samples, increase, increase / 300e0 as rate from ({WIN}) w")
def counter_rate(spark, sf):
    return TS.counter_rate(tables(spark, sf).counter_samples, 300)


@register("rate_by_label", f"select job, window_end, sum(increase / 300e0) as rate from ({WIN}) w group by job, window_end")
def rate_by_label(spark, sf):
    return TS.rate_by_label(tables(spark, sf).counter_samples, "job", 300)


def _hq_sql(q: float) -> str:
    return f"""(with b as (select day, le, cum_count as c, lag(le) over (partition by day order by le) as prev_le,
      lag(cum_count) over (partition by day order by le) as prev_c from duration_buckets),
  t as (select day, arg_max(cum_count, le) as total, max(le) filter (where le <> cast('Infinity' as double)) as max_finite
        from duration_buckets group by day),
  h as (select b.*, t.total, t.max_finite, {q}e0 * t.total as rank,
          row_number() over (partition by b.day order by b.le) as rn
        from b join t on b.day = t.day where b.c >= {q}e0 * t.total)
  select day, case when total <= 0 then null when le = cast('Infinity' as double) then max_finite
    when c = coalesce(prev_c, 0e0) then le
    else coalesce(prev_le, 0e0) + (le - coalesce(prev_le, 0e0)) * (rank - coalesce(prev_c, 0e0)) / (c - coalesce(prev_c, 0e0)) end as quantile
  from h where rn = 1)"""


@register("histogram_quantile", f"""
select cast(p95.day as timestamp) as day, p95.quantile as p95, p50.quantile as p50 from {_hq_sql(0.95)} p95 join {_hq_sql(0.5)} p50 on p95.day = p50.day""")
def histogram_quantile(spark, sf):
    b = tables(spark, sf).duration_buckets
    p95 = TS.histogram_quantile(b, 0.95).withColumnRenamed("quantile", "p95")
    p50 = TS.histogram_quantile(b, 0.5).withColumnRenamed("quantile", "p50")
    return p95.join(p50, "day").withColumn("day", F.col("day").cast("timestamp_ntz"))


@register("legend_calcs", """
select job, address, arg_max(value, seq) as last, min(value) as min, max(value) as max from counter_samples group by job, address""")
def legend_calcs(spark, sf):
    return TS.legend_calcs(tables(spark, sf).counter_samples)


@register("last_not_null", """
select metric_name, last_value from (select metric_name, metric_value as last_value,
  row_number() over (partition by metric_name order by timestamp desc, id desc) as rn from metrics where metric_value is not null) x
where rn = 1""")
def last_not_null(spark, sf):
    return TS.last_not_null(tables(spark, sf).metrics, ["metric_name"], "metric_value", ["timestamp", "id"]) \
             .withColumnRenamed("last_value", "last_value")


LATEST = f"""(select job, address, value from (select *, row_number() over (partition by job, address order by seq desc) as rn
  from counter_samples where ts <= {SAS}) x where rn = 1)"""


@register("requests_by_instance", f"""
select regexp_replace(address, '^([^:]+)(:[0-9]+)?$', '\\1') as instance, sum(value) as value from {LATEST} l group by 1""")
def requests_by_instance(spark, sf):
    return TS.requests_by_instance(tables(spark, sf).counter_samples, SERIES_AS_OF)


@register("ratio_of_sums", f"""
select sum(case when job = 'purchase' then value else 0e0 end) / sum(value) * 100 as ratio from {LATEST} l""")
def ratio_of_sums(spark, sf):
    return TS.ratio_of_sums(tables(spark, sf).counter_samples, "job", "purchase", SERIES_AS_OF)


@register("relabel_instance", """
select seq, address, regexp_replace(address, '^([^:]+)(:[0-9]+)?$', '\\1') as instance from counter_samples""")
def relabel_instance(spark, sf):
    s = tables(spark, sf).counter_samples
    return s.select("seq", "address", TS.instance_of(F.col("address")).alias("instance"))


@register("up_status", f"""
select job, instance, last_seen, case when (epoch_us({SAS}) - epoch_us(last_seen)) / 1e6 <= 300 then 1 else 0 end as up
from (select job, regexp_replace(address, '^([^:]+)(:[0-9]+)?$', '\\1') as instance, max(ts) as last_seen
      from counter_samples where ts <= {SAS} group by 1, 2) g""")
def up_status(spark, sf):
    return TS.up_status(tables(spark, sf).counter_samples, SERIES_AS_OF)


@register("counter_rate_extrapolated", f"""
with d as ({DELTAS.format(src='counter_samples')}),
g as (select job, address, cast(ceil(epoch_us(ts) / 300000000e0) * 300000000 as bigint) as e,
        sum(coalesce(delta, 0e0)) - arg_min(coalesce(delta, 0e0), seq) as inc, arg_min(epoch_us(ts), seq) as t0,
        arg_max(epoch_us(ts), seq) as t1, arg_min(value, seq) as v0, count(*) as n
      from d group by 1, 2, 3 having count(*) >= 2),
x as (select *, (t1 - t0) / 1e6 as sampled, (t0 - (e - 300000000)) / 1e6 as to_start0, (e - t1) / 1e6 as to_end from g),
y as (select *, sampled / (n - 1) as avg_gap,
        case when inc > 0 and v0 >= 0 and sampled * (v0 / inc) < to_start0 then sampled * (v0 / inc) else to_start0 end as to_start from x),
z as (select *, sampled + case when to_start < avg_gap * 1.1e0 then to_start else avg_gap / 2 end
                        + case when to_end < avg_gap * 1.1e0 then to_end else avg_gap / 2 end as ext from y)
select job, address, make_timestamp(e) as window_end, n as samples,
  case when sampled > 0 then inc * ext / sampled end as increase, case when sampled > 0 then inc * ext / sampled end / 300e0 as rate
from z""")
def counter_rate_extrapolated(spark, sf):
    return TS.extrapolated_increase(tables(spark, sf).counter_samples, 300)


# ---- range vectors: windows that slide by a step ----------------------------------------------

DAY_BEFORE = "2024-01-19 00:00:00"


def range_sql(src: str, series: str, window: int, step: int, between: tuple[str, str] | None = None) -> str:
    """Increase per series and step: samples joined to every window they lie in."""
    w, g = window * 1_000_000, step * 1_000_000
    inside = "" if between is None else f"where t between epoch_us(timestamp '{between[0]}') and epoch_us(timestamp '{between[1]}')"
    near = "" if between is None else (f"where ts > timestamp '{between[0]}' - interval {window + step} second "
                                       f"and ts <= timestamp '{between[1]}'")
    return f"""(with s as materialized (select {series}, seq, epoch_us(ts) as us, value from {src} {near}),
  steps as (select distinct {series}, t from (select {series}, unnest(range(0, {window // step})) * {g} + cast(ceil(us / {g}e0) as bigint) * {g} as t from s) x {inside}),
  hit as (select {series}, t, seq, us, value, lag(value) over (partition by {series}, t order by us, seq) as prev
          from steps join s using ({series}) where us > t - {w} and us <= t)
  select {series}, make_timestamp(t) as t, count(*) as samples,
    sum(case when prev is null then 0e0 when value < prev then value else value - prev end) as increase
  from hit group by {series}, t)"""


@register("counter_increase_range", f"select * from {range_sql('counter_samples', 'job, address', 86400, 60, (DAY_BEFORE, SERIES_AS_OF))} r")
def counter_increase_range(spark, sf):
    """``increase(counter[24h])`` each minute of a day."""
    return RV.increase_over(tables(spark, sf).counter_samples, 86400, 60, start=DAY_BEFORE, end=SERIES_AS_OF)


@register("counter_rate_range", f"select *, increase / 300e0 as rate from {range_sql('counter_samples', 'job, address', 300, 15)} r")
def counter_rate_range(spark, sf):
    """``rate(counter[5m])`` every 15 seconds, over all samples."""
    return RV.rate_over(tables(spark, sf).counter_samples, 300, 15)


@register("rate_by_label_range", f"select job, t, sum(increase / 60e0) as rate from {range_sql('counter_samples', 'job, address', 60, 15)} r group by job, t")
def rate_by_label_range(spark, sf):
    """``sum by (job) (rate(counter[1m]))`` every 15 seconds, over all samples."""
    return RV.rate_by(tables(spark, sf).counter_samples, "job", 60, 15)


def _hq_range_sql(q: float, name: str) -> str:
    return f"""case when total > 0 then case when le = cast('Infinity' as double) then low when c = below then le
      else low + (le - low) * ({q}e0 * total - below) / (c - below) end end as {name}"""


def _hq_hit(q: float) -> str:
    return f"(select * from (select *, row_number() over (partition by job, t order by le) as rn from b where c >= {q}e0 * total) x where rn = 1)"


@register("histogram_quantile_range", f"""
with r as (select job, le, t, increase / 3600e0 as rate from {range_sql('bucket_samples', 'job, le', 3600, 60)} i),
m as (select *, max(rate) over (partition by job, t order by le) as c from r),
b as materialized (select job, t, le, c, coalesce(lag(le) over o, 0e0) as low, coalesce(lag(c) over o, 0e0) as below, max(c) over (partition by job, t) as total
  from m window o as (partition by job, t order by le))
select job, t, {_hq_range_sql(0.5, 'p50')}, p95 from {_hq_hit(0.5)} h join (select job, t, {_hq_range_sql(0.95, 'p95')} from {_hq_hit(0.95)} g) k using (job, t)""")
def histogram_quantile_range(spark, sf):
    """p50 and p95 over ``rate(duration_bucket[1h])`` each minute, over all samples."""
    return RV.quantiles_over(tables(spark, sf).bucket_samples, {"p50": 0.5, "p95": 0.95}, 3600, 60, ["job"])
