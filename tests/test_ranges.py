"""Running aggregates over sampled ranges equal plain windows, with one key and one instant holding most rows."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.operators.scan import ranges, running


def _rows(spark, n=6000):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, "b", "c"]) if rnd.random() < .1 else "hot", None if rnd.random() < .02 else rnd.choice([7, 7, 7, 8]), i,
             rnd.randint(-9, 9), rnd.getrandbits(63), rnd.choice([None, None, None, f"v{i}"])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t long, id long, x long, bits long, v string")


def _plain(df, end):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, end)
    return df.select("id", F.coalesce(F.sum("x").over(w), F.lit(0)).alias("s"), F.coalesce(F.bit_xor("bits").over(w), F.lit(0)).alias("b"),
                     F.last("v", ignorenulls=True).over(w).alias("l"))


def test_running_equals_windows(spark):
    df = _rows(spark).persist()
    for current in (False, True):
        for parts in (1, 13):
            got = running(df, ["k"], ["t", "id"], sums={"s": F.col("x")}, xors={"b": F.col("bits")}, last={"l": F.col("v")},
                          include_current=current, parts=parts)
            assert got.columns == [*df.columns, "s", "b", "l"]
            want = _plain(df, Window.currentRow if current else -1)
            assert sorted(map(tuple, got.select("id", "s", "b", "l").collect())) == sorted(map(tuple, want.collect()))


def test_parts_hold_about_the_same(spark):
    df = _rows(spark, 20_000)  # 90 % of one key, three quarters of them at one instant
    n = [r["count"] for r in ranges(df, ["k"], ["t", "id"], 10).groupBy("_part").count().collect()]
    assert len(n) == 10 and sum(n) == 20_000 and max(n) <= 2 * 20_000 / 10


def test_empty(spark):
    df = _rows(spark, 5).where("false")
    assert running(df, ["k"], ["t"], sums={"s": F.col("x")}).collect() == []
