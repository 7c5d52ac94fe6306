"""Registered queries: prediction features, history features, MLlib training / scoring / report
(P3, P4, P6, P7, W5-W7, L1-L9, S11, S12, T4).

Model-backed keys have no SQL oracle (the driver records a rows-only check); their invariants
are asserted in tests. Models are trained once per input folder and process, then reused.
"""

from __future__ import annotations

import datetime as _dt
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from ..operators import classify_ops as K
from ..operators import healing as H
from ..operators import ml as ML
from ..operators import runs as R
from ..operators import vcs as V
from ..operators.scan import spread
from ..plans.session import checkpoint_path, ensure_checkpoint_dir
from ..sources.tables import session_key, tables
from .q_healing import SCORED
from .q_runs import AS_OF, AS_OF_SQL
from .registry import register

TRAINED_AT = "2024-02-01 00:00:00"
_MODELS: dict[tuple, dict] = {}


def training_frame(t):
    """Run features with the failure label of the scoring rule (P8), the 12 model features."""
    scored = H.failure_risk_score(t.run_features)
    return ML.extract_features(scored, AS_OF, keep=["id", F.col("failure_label").alias("label")])


def healing_samples(t):
    """Healing features of analysed failures whose run had an action; label = that action's success."""
    feats = H.healing_features(K.analyze_failure(spread(t.job_logs)))
    first = R.first_action_per_run(t.healing_actions).select("run_id", F.col("success").cast("int").alias("label"))
    return feats.join(first, "run_id", "inner")


def models(spark, sf):
    key = (*session_key(spark), sf)
    if key not in _MODELS:
        t = tables(spark, sf)
        data = ML.split_train_test(training_frame(t))
        train, test = data.filter("split = 'train'"), data.filter("split = 'test'")
        hs = ML.split_train_test(healing_samples(t), id_col="log_id")
        ensure_checkpoint_dir(spark)
        # the forest has few long jobs and the boosting hundreds of short ones, so each runs in the other's gaps
        with ThreadPoolExecutor(2) as both:
            fit = both.submit(inheritable_thread_target(spark)(ML.train_healing_model), hs.filter("split = 'train'"))
            failure = ML.train_failure_model(train)
            healing, decision = fit.result()
        _MODELS[key] = {"failure": failure, "test": test, "healing": healing, "decision": decision,
                        "healing_test": hs.filter("split = 'test'")}
    return _MODELS[key]


TRAIN_SQL = f"""select id, label, build_duration_avg, test_count, changed_files, commit_size, hour(created_at) as hour_of_day,
  isodow(created_at) - 1 as day_of_week, previous_failures, dependency_changes, code_complexity, test_coverage,
  author_failure_rate, branch_age_days
from (select *, failure_label as label from ({SCORED}) s) x"""
SPLIT = "case when ('0x' || substr(md5(cast(id as varchar)), 1, 8))::bigint % 100 < 80 then 'train' else 'test' end"


@register("split_train_test", f"select id, {SPLIT} as split from run_features")
def split_train_test(spark, sf):
    return ML.split_train_test(tables(spark, sf).run_features.select("id"))


def _scale_sql() -> str:
    parts = " union all ".join(
        f"select '{f}' as feature, round(avg({f}), 6) as mean, round(stddev_pop({f}), 6) as std from tr" for f in ML.FEATURES)
    return f"with tr as (select * from ({TRAIN_SQL}) t where {SPLIT} = 'train') {parts}"


@register("standard_scale", _scale_sql())
def standard_scale(spark, sf):
    d = ML.split_train_test(training_frame(tables(spark, sf))).filter("split = 'train'")
    p = ML.scale_params(d)
    return p.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


PAYLOAD = """select seq, id, created_at,
  cast(case when coalesce(run_attempt, 0) <> 0 then run_attempt else 0 end as double) as commit_size,
  cast(case when coalesce(run_number, 0) <> 0 then run_number else 0 end as double) as previous_failures,
  cast(coalesce(test_coverage, 0) as double) as test_coverage, cast(coalesce(changed_files, 0) as double) as changed_files,
  cast(coalesce(dependency_changes, 0) as double) as dependency_changes, cast(coalesce(code_complexity, 0) as double) as code_complexity,
  cast(coalesce(test_count, 0) as double) as test_count
from polled_runs"""


@register("prediction_payload", PAYLOAD)
def prediction_payload(spark, sf):
    return ML.prediction_payload(tables(spark, sf).polled_runs)


CREATED = "coalesce(created_at, timestamp '2025-01-01 00:00:00')"
FEATURES_SQL = f"""select seq, id, 300e0 as build_duration_avg, test_count, changed_files, commit_size,
  cast(hour({CREATED}) as double) as hour_of_day, cast(isodow({CREATED}) - 1 as double) as day_of_week, previous_failures,
  dependency_changes, code_complexity, test_coverage, 0.10e0 as author_failure_rate,
  cast(floor((epoch_us({AS_OF_SQL}) - epoch_us({CREATED})) / 86400000000e0) as double) as branch_age_days
from ({PAYLOAD}) p"""


def _payload_features(t):
    return ML.extract_features(ML.prediction_payload(t.polled_runs), AS_OF, keep=["seq", "id"])


@register("extract_features", FEATURES_SQL)
def extract_features(spark, sf):
    return _payload_features(tables(spark, sf))


FACTORS_SQL = "concat_ws('; ', " + ", ".join(
    f"case when {c} {op} {t} then '{txt}' end" for c, op, t, txt in ML.RISK_FACTORS) + ")"


@register("risk_factors", f"""
select seq, id, case when {FACTORS_SQL} = '' then '{ML.NO_RISK_FACTORS}' else {FACTORS_SQL} end as factors from ({FEATURES_SQL}) f""")
def risk_factors(spark, sf):
    f = _payload_features(tables(spark, sf))
    return f.select("seq", "id", F.array_join(ML.risk_factors(), "; ").alias("factors"))


CONF = "least(greatest(failure_score, 0e0), 1e0)"
RISK_SQL = "case " + " ".join(f"when {CONF} >= {t}e0 then '{n}'" for t, n in ML.RISK_LEVELS) + f" else '{ML.RISK_LEVEL_DEFAULT}' end"


@register("risk_level", f"select id, {CONF} as confidence, {CONF} > 0.5e0 as will_fail, {RISK_SQL} as risk_level from ({SCORED}) s")
def risk_level(spark, sf):
    s = H.failure_risk_score(tables(spark, sf).run_features)
    c = F.least(F.greatest("failure_score", F.lit(0.0)), F.lit(1.0))
    return s.select("id", c.alias("confidence"), (c > 0.5).alias("will_fail"), ML.risk_level(c).alias("risk_level"))


RUNS_WITH_AUTHOR = """select r.*, l.author from pipeline_runs r join (select run_id, author from (
  select *, row_number() over (partition by run_id order by seq desc) as rn from run_events) x where rn = 1) l on r.run_id = l.run_id"""
EARLIER = "rows between unbounded preceding and 1 preceding"


def _runs_with_author(t):
    return V.run_attributes(t.run_events)  # one aggregate: run fields and the latest author


@register("previous_failures", f"""
select run_id, repo, created_at, cast(coalesce(sum(case when conclusion = 'failure' then 1 else 0 end)
  over (partition by repo order by created_at, id {EARLIER}), 0) as bigint) as previous_failures from pipeline_runs""")
def previous_failures(spark, sf):
    return ML.previous_failures(tables(spark, sf).runs)


@register("author_failure_rate", f"""
select run_id, author, created_at, case when n > 0 then f / n else 0.10e0 end as author_failure_rate from (
  select *, cast(count(*) over w as double) as n, cast(coalesce(sum(case when conclusion = 'failure' then 1 else 0 end) over w, 0) as double) as f
  from ({RUNS_WITH_AUTHOR}) r window w as (partition by author order by created_at, id {EARLIER})) x""")
def author_failure_rate(spark, sf):
    return ML.author_failure_rate(_runs_with_author(tables(spark, sf)))


@register("build_duration_avg", f"""
select run_id, repo, created_at, case when n > 0 then s / n / 1e6 else 300e0 end as build_duration_avg from (
  select *, cast(coalesce(sum(case when completed_at is not null then 1 else 0 end) over w, 0) as double) as n,
    cast(coalesce(sum(case when completed_at is not null then epoch_us(completed_at) - epoch_us(started_at) else 0 end) over w, 0) as double) as s
  from pipeline_runs window w as (partition by repo order by created_at, id {EARLIER})) x""")
def build_duration_avg(spark, sf):
    return ML.build_duration_avg(tables(spark, sf).runs)


@register("retrain_check", f"""
select n as samples, accuracy, accuracy < 0.8e0 as accuracy_low, {((_dt.datetime.fromisoformat(AS_OF) - _dt.datetime.fromisoformat(TRAINED_AT)).total_seconds() / 3600)}e0 as model_age_hours,
  {str((_dt.datetime.fromisoformat(AS_OF) - _dt.datetime.fromisoformat(TRAINED_AT)).total_seconds() / 3600 > 168).lower()} as model_stale,
  n >= 100 as enough_samples, n >= 1000 as enough_samples_strict,
  (accuracy < 0.8e0 or {str((_dt.datetime.fromisoformat(AS_OF) - _dt.datetime.fromisoformat(TRAINED_AT)).total_seconds() / 3600 > 168).lower()}) and n >= 100 as retrain
from (select count(*) as n, case when count(*) > 0 then count(*) filter (where label = prediction) / cast(count(*) as double) else 0e0 end as accuracy
      from predictions) x""")
def retrain_check(spark, sf):
    return ML.retrain_check(tables(spark, sf).predictions, TRAINED_AT, AS_OF)


# ---- model-backed keys (rows-only check) -----------------------------------------------------

@register("train_failure_model")
def train_failure_model(spark, sf):
    m = models(spark, sf)
    s = m["failure"].transform(spread(m["test"]))
    return s.select("id", "label", F.col("prediction").cast("int").alias("prediction"),
                    ML.positive_probability(s).alias("probability"))


@register("failure_model_metrics")
def failure_model_metrics(spark, sf):
    m = models(spark, sf)
    return ML.evaluate(m["failure"], m["test"])


@register("cross_validate_f1")
def cross_validate_f1(spark, sf):
    d = ML.split_train_test(training_frame(tables(spark, sf))).filter("split = 'train'")
    return ML.cross_validate_f1(d)


@register("train_healing_model")
def train_healing_model(spark, sf):
    m = models(spark, sf)
    return ML.predict_healing(m["healing"], m["healing_test"], ["log_id", "label"], m["decision"])


@register("predict_failure")
def predict_failure(spark, sf):
    f = _payload_features(tables(spark, sf))
    p = ML.predict_failure(models(spark, sf)["failure"], f, ["seq", "id"])
    return p.withColumn("factors", F.array_join("factors", "; "))


@register("predict_healing")
def predict_healing(spark, sf):
    m = models(spark, sf)
    feats = H.healing_features(K.analyze_failure(spread(tables(spark, sf).job_logs)))
    return ML.predict_healing(m["healing"], feats, ["log_id", "run_id"], m["decision"])


@register("feature_importance")
def feature_importance(spark, sf):
    return ML.feature_importance(models(spark, sf)["failure"], spark)


@register("top_features")
def top_features(spark, sf):
    return ML.top_features(ML.feature_importance(models(spark, sf)["failure"], spark))


@register("model_save_load")
def model_save_load(spark, sf):
    m = models(spark, sf)
    path = checkpoint_path(spark, f"models/{abs(hash(sf))}")
    ML.save_models(spark, path, m["failure"], m["healing"], TRAINED_AT)
    failure, healing, meta = ML.load_models(spark, path)
    test = spread(m["test"])
    before = m["failure"].transform(test)
    before = before.select("id", ML.positive_probability(before).alias("p_before"))
    s = failure.transform(test)
    after = s.select("id", ML.positive_probability(s).alias("p_after"))
    return before.join(after, "id").withColumn("equal", F.col("p_before") == F.col("p_after")) \
                 .withColumn("has_healing_model", F.lit(healing is not None)) \
                 .withColumn("version", F.lit(meta["version"]))


@register("training_report")
def training_report(spark, sf):
    m = models(spark, sf)
    fm = ML.evaluate(m["failure"], m["test"])
    hm = ML.evaluate(m["healing"], m["healing_test"]) if m["healing"] is not None else None
    return ML.training_report(spark, fm, hm, ML.feature_importance(m["failure"], spark))
