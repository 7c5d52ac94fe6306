"""One key holding a third of the rows: results stay exact and no window over raw rows is
partitioned by the hot key alone (every such window also splits by a chunk column)."""

import json
import random

from pyspark.sql import functions as F

from runlens.operators import runs as R
from runlens.operators import timeseries as TS
from runlens.operators.scan import lag_by


def _events(spark, n=3000):
    rnd = random.Random(3)
    rows = []
    for seq in range(n):
        run = "0" if seq % 3 == 0 else str(rnd.randint(1, 200))  # run "0" holds a third of the rows
        rows.append((seq, run, f"2024-01-01 00:{(seq // 60) % 60:02d}:{seq % 60:02d}",
                     rnd.choice(["queued", "in_progress", "completed"]), rnd.choice([None, "success", "failure"]),
                     f"org/repo-{rnd.randint(0, 3)}"))
    df = spark.createDataFrame(rows, "seq long, run_id string, ts string, status string, conclusion string, repo string")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), rows


def test_hot_run_upsert_exact(spark):
    df, rows = _events(spark)
    got = {r.run_id: r for r in R.run_upsert(df).collect()}
    hot = [r for r in rows if r[1] == "0"]
    first, last = min(hot, key=lambda r: r[0]), max(hot, key=lambda r: r[0])
    assert got["0"].repo == first[5] and got["0"].status == last[3] and got["0"].conclusion == last[4]
    assert len(got) == len({r[1] for r in rows})


def _window_partition_names(df):
    spark = df.sparkSession
    prev = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the static plan (AQE wraps it until run)
    try:
        nodes = json.loads(df._jdf.queryExecution().executedPlan().toJSON())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", prev)
    out = []
    for n in nodes:
        if n["class"].endswith("WindowExec"):
            names = {e.get("name") for spec in n.get("partitionSpec") or [] for e in spec}
            out.append(names)
    return out


def test_hot_key_windows_are_chunked(spark):
    df, _ = _events(spark)
    lagged = lag_by(df, ["run_id"], "seq", "seq", "prev", chunk=64)
    specs = _window_partition_names(lagged)
    # windows over raw rows carry _chunk; the only others run over the per-chunk summary
    assert any("_chunk" in s for s in specs)
    assert all("_chunk" in s or s == {"run_id"} for s in specs)
    hot_prev = sorted((r.seq, r.prev) for r in lagged.filter("run_id = '0'").collect())
    assert all(p == (hot_prev[i - 1][0] if i else None) for i, (_, p) in enumerate(hot_prev))


def test_hot_series_rate_exact(spark):
    rows = [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", "job", "host-0:9100", float(i % 50 + 1)) for i in range(1800)]
    df = spark.createDataFrame(rows, "seq long, ts string, job string, address string, value double") \
              .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.window_end.minute if r.window_end.hour == 0 else 60: r.increase for r in TS.windowed_increase(df, 300).collect()}
    # brute force: per 5-minute window (t-300, t], sum of reset-corrected deltas after the first sample
    wins = {}
    for seq, ts, _, _, v in rows:
        sec = int(ts[-5:-3]) * 60 + int(ts[-2:])
        end = -(-sec // 300) * 300
        wins.setdefault(end, []).append((seq, v))
    for end, samples in wins.items():
        samples.sort()
        inc = 0.0
        for (_, a), (_, b) in zip(samples, samples[1:]):
            inc += b if b < a else b - a
        key = (end // 60) if end < 3600 else 60
        assert abs(got[key] - inc) < 1e-9, end


def test_history_and_asof_are_dealt_out_by_rows(spark):
    """One repository and one day hold 90 % of the runs and failures; results equal plain windows."""
    import datetime

    from pyspark.sql.window import Window

    from runlens.operators import ml as ML
    from runlens.operators import vcs as V
    from runlens.operators.scan import ranges
    rnd, day = random.Random(8), datetime.datetime(2024, 1, 5)
    rows = []
    for i in range(4000):
        hot = rnd.random() < .9
        at = day + datetime.timedelta(seconds=rnd.randrange(3600)) if hot else day + datetime.timedelta(days=rnd.randrange(1, 30))
        rows.append((str(i), i, "org/hot" if hot else f"org/{rnd.randrange(9)}", at, at, at + datetime.timedelta(seconds=rnd.randrange(900)) if i % 3 else None,
                     rnd.choice(["success", "failure", None]), "push" if i % 2 else "pull_request", f"{i:040d}"))
    df = spark.createDataFrame(rows, "run_id string, id long, repo string, created_at timestamp_ntz, started_at timestamp_ntz, "
                                     "completed_at timestamp_ntz, conclusion string, event string, head_sha string").persist()
    w = Window.partitionBy("repo").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce(F.sum((F.col("conclusion") == "failure").cast("int")).over(w), F.lit(0))
    assert sorted(map(tuple, ML.previous_failures(df).select("run_id", "previous_failures").collect())) == \
        sorted(map(tuple, df.select("run_id", failed).collect()))
    took = F.when(F.col("completed_at").isNotNull(), F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp")))
    mean = F.coalesce(F.sum(took).over(w) / F.count(took).over(w) / 1e6, F.lit(300.0))
    assert sorted(map(tuple, ML.build_duration_avg(df).select("run_id", "build_duration_avg").collect())) == \
        sorted(map(tuple, df.select("run_id", mean).collect()))
    fails = df.where("conclusion = 'failure'").select(F.col("id").alias("log_id"), "run_id", "created_at")
    got = {r.log_id: r.head_sha for r in V.last_good_run_asof(fails, df).collect()}
    good = [r for r in rows if r[6] == "success" and r[7] == "push"]
    for r in rnd.sample([r for r in rows if r[6] == "failure"], 200):
        before = [g for g in good if g[2] == r[2] and g[3] < r[3]]
        assert got[r[1]] == (max(before, key=lambda g: (g[3], g[1]))[8] if before else None)
    sizes = sorted(r["count"] for r in ranges(df, ["repo"], ["created_at", "id"], 8).groupBy("_part").count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
