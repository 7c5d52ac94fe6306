"""Stored tables: retention equals the keep-sets of S10 and the upsert the full outer join, each all or nothing."""

import uuid

import pytest
from pyspark.sql import functions as F

from runlens.operators import runs as R
from runlens.plans.session import checkpoint_path
from runlens.sources import store as ST
from runlens.sources.tables import tables
from runlens.sources.versioned import Conflict, Store, compact, current


def fresh(spark):
    return checkpoint_path(spark, f"tables/store-{uuid.uuid4().hex}")


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def sources(spark, sf):
    t = tables(spark, sf)
    return {"runs": t.runs, "failure_logs": t.failure_logs, "healing_actions": t.healing_actions, "metrics": t.metrics}


@pytest.mark.parametrize("as_of", ["2024-02-10 00:00:00", "2024-02-10 12:34:56"])
def test_retention_equals_keep_sets(spark, sf, as_of):
    src = sources(spark, sf)
    store = ST.write_tables(*src.values(), fresh(spark))
    dropped = ST.apply_retention(store, as_of, days=30)
    assert dropped["runs"] > 0 and dropped["metrics"] > 0
    for name, df in R.retention(*src.values(), as_of=as_of, days=30).items():
        assert rows(store.read(name)) == rows(df), name


def test_retention_that_dies_leaves_the_old_version(spark, sf, monkeypatch):
    src = sources(spark, sf)
    store = ST.write_tables(*src.values(), fresh(spark))
    before = {n: rows(store.read(n)) for n in ST.TABLES}

    def die(self, state):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", die)
        with pytest.raises(RuntimeError, match="lost"):
            ST.apply_retention(store, "2024-02-10 12:34:56", days=30)
    assert {n: rows(store.read(n)) for n in ST.TABLES} == before
    ST.apply_retention(store, "2024-02-10 12:34:56", days=30)
    want = R.retention(*src.values(), as_of="2024-02-10 12:34:56", days=30)
    assert all(rows(store.read(n)) == rows(want[n]) for n in ST.TABLES)
    assert store.clean(keep_versions=1) > 0   # the first run's folders and the old days
    assert all(rows(store.read(n)) == rows(want[n]) for n in ST.TABLES)


def test_upsert_reads_only_the_parts_it_touches(spark, sf):
    src = sources(spark, sf)
    events = tables(spark, sf).run_events
    cut = "2024-01-20 00:00:00"
    first = R.run_upsert(events.where(F.col("ts") < R.ts_lit(cut)))
    store = ST.write_tables(first, *list(src.values())[1:], fresh(spark))
    more = events.where(F.col("ts") >= R.ts_lit(cut)).unionByName(  # a run without a number, and one seen anew
        events.limit(1).withColumn("run_id", F.lit("gone-1")))
    parts = ST.upsert_runs(store, more)
    assert 0 < len(parts) < first.select(F.to_date("created_at")).distinct().count() / 2
    assert rows(store.read("runs")) == rows(R.run_upsert(more, first))
    again = ST.upsert_runs(store, events.where("run_id = '3'"))
    assert [p["by"] for p in again] == [str(r[0]) for r in first.where("run_id = '3'").select(F.to_date("created_at")).collect()]


def test_writers_that_meet(spark):
    store = Store(spark, fresh(spark))
    n = lambda v, k: spark.createDataFrame([(k, v)], "k string, n long")
    store.write({"t": n(1, "a")})
    parts, done = store.stage(n(5, "a")), []

    def change(state):
        if not done:                      # another writer publishes between our reading and our publishing
            done.append(1)
            other = store.stage(n(7, "b"))
            store.commit(lambda s: store.put(s, "t", n(0, "").schema, other))
        return store.put(state, "t", n(0, "").schema, parts)
    store.commit(change)
    assert store.versions() == [1, 2, 3]
    assert sorted(map(tuple, current(store, "t", ["k"], {"n": "sum"}).collect())) == [("a", 6), ("b", 7)]
    compact(store, "t", ["k"], {"n": "sum"}, closed="n > 6")
    assert sorted(map(tuple, store.read("t").collect())) == [("a", 6), ("b", 7)]
    assert sorted(p["closed"] for p in store.parts("t")) == [False, True]
    assert sorted(map(tuple, store.read("t", version=1).collect())) == [("a", 1)]
    with pytest.raises(Conflict):
        store._publish({**store.state(), "version": 1})
