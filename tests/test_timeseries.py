"""Quantile and extrapolated-rate edge cases against small Python implementations."""

import calendar
import math
import random

from pyspark.sql import functions as F

from runlens.operators import timeseries as TS

INF = float("inf")


def py_quantile(q, buckets):
    """Cumulative buckets [(le, count)] sorted by le, last le = +Inf."""
    total = buckets[-1][1]
    if total <= 0:
        return None
    rank = q * total
    for i, (le, c) in enumerate(buckets):
        if c >= rank:
            if le == INF:
                return buckets[-2][0]
            start, cstart = (buckets[i - 1] if i else (0.0, 0.0))
            return start + (le - start) * (rank - cstart) / (c - cstart)
    return None


def test_histogram_quantile_edges(spark):
    groups = {
        "normal": [(5.0, 2.0), (10.0, 6.0), (25.0, 9.0), (INF, 10.0)],
        "empty": [(5.0, 0.0), (10.0, 0.0), (INF, 0.0)],
        "in_inf": [(5.0, 1.0), (10.0, 2.0), (INF, 100.0)],
        "first": [(5.0, 90.0), (10.0, 95.0), (INF, 100.0)],
    }
    rows = [(g, le, c) for g, bs in groups.items() for le, c in bs]
    df = spark.createDataFrame(rows, "day string, le double, cum_count double")
    for q in (0.5, 0.95, 0.99):
        got = {r.day: r.quantile for r in TS.histogram_quantile(df, q).collect()}
        for g, bs in groups.items():
            want = py_quantile(q, bs)
            assert (got[g] is None and want is None) or abs(got[g] - want) < 1e-9, (g, q, got[g], want)


def py_extrapolated(samples, end, w):
    """samples: [(t_seconds, value)] inside (end - w, end], time order."""
    if len(samples) < 2:
        return None
    inc = 0.0
    for (_, a), (_, b) in zip(samples, samples[1:]):
        inc += b if b < a else b - a
    t0, v0 = samples[0]
    t1 = samples[-1][0]
    sampled = t1 - t0
    to_start, to_end = t0 - (end - w), end - t1
    avg = sampled / (len(samples) - 1)
    if inc > 0 and v0 >= 0:
        to_start = min(to_start, sampled * (v0 / inc))
    ext = sampled + (to_start if to_start < avg * 1.1 else avg / 2) + (to_end if to_end < avg * 1.1 else avg / 2)
    return inc * ext / sampled if sampled > 0 else None


def test_extrapolated_increase_matches_python(spark):
    rnd = random.Random(5)
    rows, t, v = [], 0, 0.0
    for seq in range(600):
        t += rnd.choice([7, 15, 15, 15, 31])
        v = 0.0 if rnd.random() < 0.03 else v + rnd.randint(0, 9)
        rows.append((seq, t, "j", "h:1", v))
    df = spark.createDataFrame(rows, "seq long, t long, job string, address string, value double") \
              .withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t")
    got = {calendar.timegm(r.window_end.timetuple()): r.increase for r in TS.extrapolated_increase(df, 300).collect()}
    wins = {}
    for _, ts, _, _, val in rows:
        end = -(-ts // 300) * 300
        wins.setdefault(end, []).append((ts, val))
    for end, s in wins.items():
        want = py_extrapolated(s, end, 300)
        if want is None:
            assert end not in got or got[end] is None
        else:
            assert math.isclose(got[end], want, rel_tol=1e-9, abs_tol=1e-9), end


def test_rate_extrapolate_option(spark):
    rows = [(i, i * 15, "j", "h:1", float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "seq long, t long, job string, address string, value double") \
              .withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t")
    a = {r.window_end: r.rate for r in TS.counter_rate(df, 300, extrapolate=True).collect()}
    b = {r.window_end: r.rate for r in TS.extrapolated_increase(df, 300).collect()}
    assert a == b
    lbl = TS.rate_by_label(df, "job", 300, extrapolate=True).collect()
    assert {r.window_end for r in lbl} == set(a)
