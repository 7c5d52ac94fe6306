"""Chunk-parallel helpers must equal the plain single-partition windows they replace."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.operators.scan import lag_by, last_non_null_before, running_sum_by


def _data(spark, n=600):
    rnd = random.Random(7)
    rows = []
    for seq in range(n):
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 5)}"  # one key holds most rows
        v = float(rnd.randint(0, 9)) if rnd.random() > 0.3 else None
        rows.append((key, seq * 3 + rnd.randint(0, 2), v))
    return spark.createDataFrame(rows, "key string, seq long, v double")


def test_lag_by_equals_window(spark):
    df = _data(spark).filter(F.col("v").isNotNull())
    want = df.withColumn("p", F.lag("v").over(Window.partitionBy("key").orderBy("seq")))
    got = lag_by(df, ["key"], "seq", "v", "p", chunk=17)
    assert sorted(want.collect()) == sorted(got.select(*want.columns).collect())
    glob = lag_by(df, [], "seq", "v", "p", chunk=13)  # one global sequence
    w_glob = df.withColumn("p", F.lag("v").over(Window.orderBy("seq")))
    assert sorted(w_glob.collect()) == sorted(glob.select(*w_glob.columns).collect())


def test_running_sum_equals_window(spark):
    df = _data(spark).withColumn("x", F.coalesce("v", F.lit(0.0)))
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("s", F.coalesce(F.sum("x").over(w), F.lit(0.0)))
    got = running_sum_by(df, ["key"], "seq", {"s": F.col("x")}, chunk=11)
    assert sorted(want.collect()) == sorted(got.select(*want.columns).collect())


def test_last_non_null_equals_window(spark):
    df = _data(spark)
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("c", F.last("v", ignorenulls=True).over(w))
    got = last_non_null_before(df, ["key"], "seq", "v", "c", chunk=19)
    assert sorted(want.collect()) == sorted(got.select(*want.columns).collect())
