"""Streams that are stopped or killed and started again end with the tables of their batch twins."""

import datetime
import uuid

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from runlens.operators import classify_ops as K
from runlens.operators import healing as H
from runlens.operators import runs as R
from runlens.operators import vcs as V
from runlens.plans.session import checkpoint_path
from runlens.sources import ingest as I
from runlens.sources.tables import tables
from runlens.sources.versioned import Store
from runlens.streaming import live as L
from runlens.streaming import streams as S


def folder(spark, name):
    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


class Killed(Exception):
    pass


def run_with_kills(spark, monkeypatch, start, df, order, **options):
    """Two slices arrive and are taken in; two more come, and the job dies at a batch's commit, then right after
    one; then it is started again with the same checkpoint."""
    store, checkpoint = Store(spark, folder(spark, "store")), folder(spark, "checkpoint")
    cuts = df.approxQuantile(order, [.25, .5, .75], .0001)
    path = S.landing(df.where(F.col(order) <= cuts[1]), "live", order=order, cuts=cuts[:1])
    go = lambda: start(S.source(spark, path, df.schema), store, checkpoint, **options).awaitTermination()
    go()
    assert set(store.state()["batches"].values()) == {1}
    S.landing(df.where(F.col(order) > cuts[1]), "live", order=order, cuts=cuts[2:], path=path)
    publish = Store._publish

    def before(self, state):
        raise Killed("before the version is there")

    def after(self, state):
        publish(self, state)
        raise Killed("after it is there, ahead of the checkpoint")
    for die in (before, after):
        with monkeypatch.context() as m:
            m.setattr(Store, "_publish", die)
            with pytest.raises(StreamingQueryException):
                go()
    assert set(store.state()["batches"].values()) == {2}
    go()
    assert set(store.state()["batches"].values()) == {3}
    go()
    assert set(store.state()["batches"].values()) == {3}  # nothing new, nothing twice
    return store


def delivered_runs(t):
    """S1 + S9: accepted deliveries folded into runs in one pass."""
    r = I.webhook_ingest(t.run_deliveries).where("outcome = 'received' and run_id is not null")
    g = r.groupBy("run_id").agg(F.min_by(F.struct("repo", "started_at"), "delivery_id").alias("f"),
                                F.max_by(F.struct("status", "conclusion", "completed_at"), "delivery_id").alias("l"))
    return g.select("run_id", "f.repo", "l.status", "l.conclusion", "f.started_at", "l.completed_at")


def test_webhook_runs(spark, sf, monkeypatch):
    t = tables(spark, sf)
    store = run_with_kills(spark, monkeypatch, L.webhook_runs, t.run_deliveries.select("delivery_id", "payload"), "delivery_id", compact_every=2)
    want = rows(delivered_runs(t))
    assert rows(L.runs(store)) == want
    L.compact_all(store, "webhook_runs", {"runs": L.RUNS})
    assert len(store.parts("runs")) == 1 and rows(L.runs(store)) == want
    assert store.read("runs").count() == len(want)  # a row per run, not per delivery


def test_first_observations(spark, sf, monkeypatch):
    t = tables(spark, sf)
    polled = t.polled_runs.join(t.events.select(F.col("event_id").alias("seq"), "ts"), "seq").select("seq", "id", "name", "status", "conclusion", "ts")
    store = run_with_kills(spark, monkeypatch, L.first_observations, polled, "seq", delay_seconds=5 * 86400, compact_every=1)
    want = R.first_observation(t.polled_runs)
    assert rows(L.observed(store)) == rows(want.select(*L.observed(store).columns))
    # ids stay open for five days of thirty: a sixth of them and a batch at most, however many there are
    state = store.state()
    open_ids = store.frame("first_observations", [p for p in store.parts("first_observations") if not p.get("closed")], state).count()
    assert 0 < open_ids <= want.count() / 3


def test_counters(spark, sf, monkeypatch):
    t = tables(spark, sf)
    store = run_with_kills(spark, monkeypatch, L.count_runs, t.webhooks.select("delivery_id", "payload"), "delivery_id")
    actions = t.healing_actions.select("id")
    L.count_actions(S.source(spark, S.landing(actions, "a", order="id"), actions.schema), store, folder(spark, "checkpoint")).awaitTermination()
    got = L.counters(store).first()
    r = I.webhook_ingest(t.webhooks).where("outcome = 'received'")
    assert tuple(got) == (r.count(), r.where("conclusion = 'success'").count(), actions.count())


def test_last_confidence(spark, sf, monkeypatch):
    f = tables(spark, sf).run_features
    store = run_with_kills(spark, monkeypatch, L.last_confidence, f, "id", score=L.risk_rule)
    last = L.risk_rule(f).orderBy(F.desc("id")).first()
    assert tuple(L.confidence(store).first()) == (last["confidence"], last["id"])


def heal_inputs(spark, sf):
    t = tables(spark, sf)
    attrs = V.run_attributes(t.run_events)
    context = Store(spark, folder(spark, "context"))
    context.write({"context": H.repo_context(H.repo_file_pivot(t.repo_files), V.last_good_run(attrs))})
    rates = t.healing_actions.groupBy("action_type").agg(F.avg(F.col("success").cast("double")).alias("heal_probability"))
    return t, attrs.select("run_id", "repo"), context, rates


def heal_twin(t, repos, context, probability):
    """The batch form of M5: every failure analysed, gated and planned in one pass."""
    a = probability(K.analyze_failure(t.job_logs)).join(repos, "run_id", "left")
    plan = H.plan_healing(a, context.read("context")).select("log_id", "success", "action_type", "details")
    g = H.heal_gate(a.join(plan, "log_id"), "heal_probability").persist()
    ok = (F.col("decision") == "heal") & F.col("success")
    return {"failure_logs": t.failure_logs,
            "healing_actions": g.where("decision = 'heal'").select(F.col("log_id").alias("id"), "run_id", "action_type", "success", "details",
                                                                    F.array().cast("array<string>").alias("changes_made"), "created_at"),
            "reruns": g.where(ok).select("log_id", "run_id"),
            "notifications": g.where(~ok).select("log_id", "run_id", "error_type", "heal_probability", "decision")}


def test_heal_path(spark, sf, monkeypatch):
    t, repos, context, rates = heal_inputs(spark, sf)
    store = run_with_kills(spark, monkeypatch, L.heal_failures, t.job_logs, "log_id", repos=repos, probability=L.type_rates(rates), context=context)
    want = heal_twin(t, repos, context, L.type_rates(rates))
    for name, df in want.items():
        assert rows(store.read(name)) == rows(df), name
    assert 0 < want["reruns"].count() < want["healing_actions"].count()      # healed, and healing that failed
    told = {r["decision"] for r in want["notifications"].collect()}
    assert told == {"heal", "notify"}                                          # a failed heal and the gate


def test_heal_path_with_a_saved_model(spark, sf, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from runlens.operators import ml as ML
    t, repos, context, _ = heal_inputs(spark, sf)
    samples = H.healing_features(K.analyze_failure(t.job_logs)).withColumn("label", (F.col("fixable_f") > 0).cast("int"))
    model = Pipeline(stages=[VectorAssembler(inputCols=ML.HEALING_FEATURES, outputCol="features"), LogisticRegression(maxIter=5)]).fit(samples)
    path = folder(spark, "models")
    ML.save_models(spark, path, model, model, "2024-01-01T00:00:00")
    probability = L.healing_model(ML.load_models(spark, path)[1])
    store = run_with_kills(spark, monkeypatch, L.heal_failures, t.job_logs, "log_id", repos=repos, probability=probability, context=context)
    for name, df in heal_twin(t, repos, context, probability).items():
        assert rows(store.read(name)) == rows(df), name
    assert L.healing_model(None)(K.analyze_failure(t.job_logs)).select("heal_probability").distinct().collect()[0][0] == 0.5


def test_plans_take_the_newest_context(spark, sf):
    t, repos, context, rates = heal_inputs(spark, sf)
    store, checkpoint = Store(spark, folder(spark, "store")), folder(spark, "checkpoint")
    logs = t.job_logs.where("logs like 'OOMKilled%'")  # resource_limit: needs the workflow file
    always = lambda a: a.withColumn("heal_probability", F.lit(.9))
    path = S.landing(logs, "logs", order="log_id", cuts=[])
    go = lambda: L.heal_failures(S.source(spark, path, logs.schema), store, checkpoint, repos, always, context).awaitTermination()
    go()
    before = store.read("reruns").count()
    context.write({"context": context.read("context").withColumn("workflow", F.lit(None).cast("string"))})
    S.landing(logs, "logs", order="log_id", cuts=[], path=path)
    go()
    assert before > 0 and store.read("reruns").count() == before
    assert store.read("notifications").count() == 2 * logs.count() - before


def window_twin(events):
    w = events.groupBy(F.window(F.col("ts").cast("timestamp"), "5 minutes", "1 minute").alias("w"), "event_type").agg(F.count("*").alias("events"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), "event_type", "events")


def test_rate_windows(spark, sf, monkeypatch):
    events = tables(spark, sf).events.select("event_id", "ts", "event_type")
    store = run_with_kills(spark, monkeypatch, L.rate_windows, events, "event_id")
    assert rows(L.rates(store).drop("rate")) == rows(window_twin(events))


def test_late_rows_are_kept_apart_and_windows_close(spark):
    """Every tenth event comes with the last slice. Without a delay all count; with one, those behind it do not."""
    first = datetime.datetime(2024, 1, 1)
    data = [(i, first + datetime.timedelta(minutes=i), "error" if i % 3 else "view", 3 if i % 10 == 7 else min(i // 200, 3)) for i in range(800)]
    events = spark.createDataFrame(data, "event_id long, ts timestamp_ntz, event_type string, arrival int").coalesce(1)  # a slice is one file

    def run(**options):
        store = Store(spark, folder(spark, "store"))
        stream = S.source(spark, S.landing(events, "late", order="arrival", cuts=[0, 1, 2]), events.schema)
        L.rate_windows(stream, store, folder(spark, "checkpoint"), compact_every=1, **options).awaitTermination()
        return store
    assert rows(L.rates(run()).drop("rate")) == rows(window_twin(events))
    store = run(delay_seconds=3600)
    late = events.where("arrival = 3 and event_id < 599 - 60")   # the newest of the three first slices is event 599
    assert rows(L.late_rows(store, "rate_windows")) == rows(late) and late.count() > 50
    assert rows(L.rates(store).drop("rate")) == rows(window_twin(events.join(late, "event_id", "left_anti")))
    state = store.state()
    windows = store.frame("windows", [p for p in store.parts("windows") if not p.get("closed")], state).count()
    assert 0 < windows <= 2 * (60 + 5)   # types x minutes of the delay and of a window


def test_batches_do_not_grow_with_files(spark, monkeypatch):
    """Eight files a slice: four micro-batches all the same, with every row once, and the run table they join is
    computed ahead of them."""
    from runlens.plans import q_streaming as Q
    logs = spark.range(400, numPartitions=8).select(
        ((F.col("id") * 7) % 400).alias("log_id"), F.concat(F.lit("r"), F.col("id") % 50).alias("run_id"),
        F.lit("KeyError: 'x'").alias("logs"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("created_at"))
    path = S.landing(logs, "many_files", order="log_id")
    assert S.files_per_slice(spark, path) == 8
    stream = Q._arriving(spark, logs, "many_files", "log_id")
    store, checkpoint = Store(spark, folder(spark, "store")), folder(spark, "checkpoint")
    context = Store(spark, folder(spark, "context"))
    context.write({"context": spark.createDataFrame([], "repo string, requirements string, pytest_ini string, workflow string, rollback_sha string")})
    repos = spark.range(50).select(F.concat(F.lit("r"), F.col("id")).alias("run_id"), F.lit("repo").alias("repo"))
    L.heal_failures(stream, store, checkpoint, repos, lambda a: a.withColumn("heal_probability", F.lit(0.5)), context).awaitTermination()
    assert store.state()["batches"] == {"heal_failures": 3}
    ids = sorted(r.log_id for r in store.read("notifications").collect())
    assert ids == list(range(400)) and store.read("failure_logs").count() == 400


def test_heal_stream_joins_written_runs(spark, monkeypatch):
    from runlens.plans import q_streaming as Q
    seen = {}
    monkeypatch.setattr(Q.L, "heal_failures", lambda stream, store, checkpoint, repos, *a, **k: seen.update(repos=repos) or Q_Done())
    monkeypatch.setattr(Q, "_arriving", lambda *a, **k: spark.range(0))

    class Q_Done:
        def awaitTermination(self):
            pass
    Q._heal(spark, "/root/testdata/sf0.001")
    plan = seen["repos"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
