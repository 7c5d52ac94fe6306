"""Sliding windows by panes equal the rule applied to every window by itself."""

import datetime
import random

import pytest

from runlens.operators import range_vectors as RV

EPOCH = datetime.datetime(1970, 1, 1)
FIRST = datetime.datetime(2024, 1, 1)


def samples(spark, n=700, seed=2):
    """Uneven times, counter resets, gaps, equal times, one series with most of the samples."""
    rnd, rows, value = random.Random(seed), [], {}
    t = 0
    for seq in range(n):
        t += rnd.choice([0, 1, 3, 7, 15, 16, 40, 900 if rnd.random() < .05 else 5])
        k = ("a", "x") if rnd.random() < .8 else (rnd.choice("ab"), rnd.choice("xy"))
        value[k] = rnd.choice([value.get(k, 0) + rnd.randint(0, 5)] * 9 + [rnd.randint(0, 3)])
        rows.append((seq, FIRST + datetime.timedelta(seconds=t), *k, float(value[k])))
    return spark.createDataFrame(rows, "seq long, ts timestamp_ntz, job string, address string, value double"), rows


def plain(rows, window, step, start=None, end=None):
    out = {}
    by = {}
    for seq, ts, job, address, value in rows:
        by.setdefault((job, address), []).append(((ts - EPOCH).total_seconds(), seq, value))
    for key, s in by.items():
        s.sort()
        t = -(-s[0][0] // step) * step
        while t < s[-1][0] + window:
            at = EPOCH + datetime.timedelta(seconds=t)
            inside = [v for x, _, v in s if t - window < x <= t]
            if inside and (start is None or at >= start) and (end is None or at <= end):
                out[(*key, at)] = (len(inside), sum(b if b < a else b - a for a, b in zip(inside, inside[1:])))
            t += step
    return out


@pytest.mark.parametrize("window, step", [(60, 15), (300, 15), (300, 60), (60, 60), (86400, 600)])
def test_increase_equals_every_window_by_itself(spark, window, step):
    df, rows = samples(spark)
    got = {(r.job, r.address, r.t): (r.samples, r.increase) for r in RV.increase_over(df, window, step).collect()}
    assert got == plain(rows, window, step)


def test_between(spark):
    df, rows = samples(spark)
    a, b = FIRST + datetime.timedelta(seconds=1200), FIRST + datetime.timedelta(seconds=4805)
    got = RV.rate_over(df, 300, 15, start=str(a), end=str(b))
    want = plain(rows, 300, 15, a, b)
    assert {(r.job, r.address, r.t): (r.samples, round(r.rate * 300, 9)) for r in got.collect()} == want and want
    with pytest.raises(ValueError):
        RV.increase_over(df, 100, 15)
    assert RV.increase_over(df.where("false"), 60, 15).collect() == []


def test_sum_by_label(spark):
    df, rows = samples(spark)
    want = {}
    for (job, _, t), (_, inc) in plain(rows, 60, 15).items():
        want[job, t] = want.get((job, t), 0) + inc / 60
    assert {(r.job, r.t): r.rate for r in RV.rate_by(df, "job", 60, 15).collect()} == pytest.approx(want)


def test_quantiles_lift_falling_buckets(spark):
    """Rates 1, 3, 2 (lifted to 3), 4 over bounds 1, 2, 4, inf; a group without observations; a bucket of no width."""
    end = {1.0: 60.0, 2.0: 180.0, 4.0: 120.0, float("inf"): 240.0}
    rows = [(i, FIRST + datetime.timedelta(seconds=at), g, le, v * (g == "a")) for i, (at, g, le, v) in enumerate(
        (at, g, le, v if at else 0.0) for at in (1, 50) for g in "ab" for le, v in ((le, v if at == 50 else 0.0) for le, v in end.items()))]
    df = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, g string, le double, value double")
    got = {r.g: r for r in RV.quantiles_over(df, {"p25": .25, "p50": .5, "p75": .75, "p95": .95}, 60, 60, ["g"]).collect()}
    assert got["b"].p50 is None
    assert (got["a"].p25, got["a"].p50, got["a"].p75, got["a"].p95) == (1.0, 1.5, 2.0, 4.0)
