"""Failure and healing prediction on Spark MLlib, plus the feature columns around it
(P3, P4, P6, P7, W5-W7, L1-L9, S11, S12, T4).

Training, scoring and evaluation are distributed MLlib / DataFrame jobs; the driver only holds
models and per-feature summaries (12 numbers), never rows.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.session import ensure_checkpoint_dir
from .runs import ts_lit
from .scan import running, spread, written
from .stats import classifier_metrics

# ---------------------------------------------------------------------------------------------
# Feature order, defaults, model settings and thresholds of the prediction service.
# ---------------------------------------------------------------------------------------------
FEATURES = [
    "build_duration_avg", "test_count", "changed_files", "commit_size", "hour_of_day", "day_of_week",
    "previous_failures", "dependency_changes", "code_complexity", "test_coverage", "author_failure_rate",
    "branch_age_days",
]
FEATURE_DEFAULTS = {
    "build_duration_avg": 300.0, "test_count": 50.0, "changed_files": 5.0, "commit_size": 120.0,
    "previous_failures": 0.0, "dependency_changes": 0.0, "code_complexity": 10.0, "test_coverage": 80.0,
    "author_failure_rate": 0.10,
}
DEFAULT_CREATED_AT = "2025-01-01 00:00:00"
HEALING_FEATURES = ["fixable_f", "stack_trace_len", "has_missing_package", "severity_weight", "constant"]
RISK_LEVELS = [(0.8, "very_high"), (0.6, "high"), (0.4, "medium"), (0.2, "low")]
RISK_LEVEL_DEFAULT = "very_low"
RISK_FACTORS = [
    ("previous_failures", ">", 2, "High recent failure rate"),
    ("dependency_changes", ">", 0, "Dependency changes"),
    ("commit_size", ">", 300, "Large commit size"),
    ("test_coverage", "<", 70, "Low test coverage"),
]
NO_RISK_FACTORS = "No major risk factors"
FOREST = {"numTrees": 100, "maxDepth": 15, "seed": 42}
BOOSTING = {"maxIter": 150, "stepSize": 0.05, "maxDepth": 4, "seed": 42}
# Deep trees and many boosting rounds build long lineages: cache node ids and checkpoint every
# 10 iterations (to the shared ``spark.checkpoint.dir``) so a lost executor does not replay them.
LINEAGE = {"cacheNodeIds": True, "checkpointInterval": 10}
# Rows per task of a fit. The forest caches about 0.5 kB a row and as much again in node ids, and a pass reads 1.5 kB of
# them; smaller parts would each send the statistics of all nodes of a level once more. Up to FIT_PARTS parts are smaller
# all the same, so that a fit of fewer rows does not leave cores idle; the counts do not depend on the cluster, as the
# forest draws its samples by part.
FIT_ROWS = 400_000
FIT_PARTS = 24
FIT_LEAST = 25_000  # rows of such a smaller part
HEALING_ROWS = 50_000  # distinct samples per task of the boosting fit: 600 short passes over five features
TRAIN_PERCENT = 80
CV_FOLDS = 3
MIN_HEALING_SAMPLES = 50
RETRAIN_ACCURACY = 0.80
RETRAIN_MAX_AGE_HOURS = 168
RETRAIN_MIN_SAMPLES_CONFIG = 100
RETRAIN_MIN_SAMPLES_README = 1000
DEFAULT_DURATION_SECONDS = 300.0
DEFAULT_AUTHOR_FAILURE_RATE = 0.10
MODEL_VERSION = "1.0"


# ---------------------------------------------------------------------------------------------
# P3, P4, P6, P7
# ---------------------------------------------------------------------------------------------

def prediction_payload(polled: DataFrame) -> DataFrame:
    """The prediction input the poll loop builds from a run (missing -> 0)."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    nz = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.col(c)).otherwise(F.lit(0)).cast("double")
    return polled.select(
        "seq", "id", "created_at",
        nz("run_attempt").alias("commit_size"), nz("run_number").alias("previous_failures"),
        z("test_coverage").alias("test_coverage"), z("changed_files").alias("changed_files"),
        z("dependency_changes").alias("dependency_changes"), z("code_complexity").alias("code_complexity"),
        z("test_count").alias("test_count"),
    )


def extract_features(rows: DataFrame, as_of: str, keep: list[str] | None = None) -> DataFrame:
    """The 12 model features in fixed order; absent columns and null values take the service defaults;
    hour and weekday (Monday = 0) of ``created_at`` (null -> 2025-01-01); branch age in whole
    days to ``as_of``, floored (negative ages floor down)."""
    created = F.coalesce(F.col("created_at"), ts_lit(DEFAULT_CREATED_AT))
    cols = []
    for name in FEATURES:
        if name == "hour_of_day":
            cols.append(F.hour(created).cast("double").alias(name))
        elif name == "day_of_week":
            cols.append(F.weekday(created).cast("double").alias(name))
        elif name == "branch_age_days":
            age = (F.unix_micros(ts_lit(as_of).cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 86_400_000_000
            age = F.floor(age).cast("double")
            given = F.col(name).cast("double") if name in rows.columns else F.lit(None).cast("double")
            cols.append(F.coalesce(given, age).alias(name))
        elif name in rows.columns:
            cols.append(F.coalesce(F.col(name).cast("double"), F.lit(FEATURE_DEFAULTS[name])).alias(name))
        else:
            cols.append(F.lit(FEATURE_DEFAULTS[name]).alias(name))
    return rows.select(*(keep or []), *cols)


def risk_level(p: Column) -> Column:
    """Risk bucket of a probability."""
    out = F.lit(RISK_LEVEL_DEFAULT)
    for t, name in reversed(RISK_LEVELS):
        out = F.when(p >= t, F.lit(name)).otherwise(out)
    return out


def risk_factors(features: DataFrame | None = None) -> Column:
    """The risk factors that apply, in fixed order; none -> ["No major risk factors"]."""
    items = [F.when((F.col(c) > t) if op == ">" else (F.col(c) < t), F.lit(text)) for c, op, t, text in RISK_FACTORS]
    arr = F.array_compact(F.array(*items))
    return F.when(F.size(arr) == 0, F.array(F.lit(NO_RISK_FACTORS))).otherwise(arr)


# ---------------------------------------------------------------------------------------------
# History features (definitions ours; the service only names them)
# ---------------------------------------------------------------------------------------------

def _before(runs: DataFrame, key: str, **sums: Column) -> DataFrame:
    """Sums over the earlier runs (created_at, id) of the same ``key``, dealt out by rows."""
    rows = runs.select("run_id", key, "created_at", "id", *[v.cast("bigint").alias(f"_{name}") for name, v in sums.items()])
    return running(written(rows, "run-history"), [key], ["created_at", "id", "run_id"], sums={n: F.col(f"_{n}") for n in sums})


def previous_failures(runs: DataFrame, key: str = "repo") -> DataFrame:
    """Failed runs among the earlier runs (created_at, id) of the same ``key``."""
    r = _before(runs, key, previous_failures=F.coalesce(F.col("conclusion") == "failure", F.lit(False)))
    return r.select("run_id", key, "created_at", "previous_failures")


def author_failure_rate(runs: DataFrame) -> DataFrame:
    """The author's failure share over their earlier runs; 0.10 when they have none."""
    r = _before(runs, "author", n=F.lit(1), f=F.coalesce(F.col("conclusion") == "failure", F.lit(False)))
    rate = F.when(F.col("n") > 0, F.col("f") / F.col("n")).otherwise(F.lit(DEFAULT_AUTHOR_FAILURE_RATE))
    return r.select("run_id", "author", "created_at", rate.alias("author_failure_rate"))


def build_duration_avg(runs: DataFrame, key: str = "repo") -> DataFrame:
    """Mean duration in seconds of the earlier completed runs of the same ``key``; 300 when none."""
    done = F.col("completed_at").isNotNull()
    micros = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    r = _before(runs, key, n=done, s=F.when(done, micros).otherwise(0))
    avg = F.when(F.col("n") > 0, F.col("s") / F.col("n") / 1e6).otherwise(F.lit(DEFAULT_DURATION_SECONDS))
    return r.select("run_id", key, "created_at", avg.alias("build_duration_avg"))


# ---------------------------------------------------------------------------------------------
# L1, L2
# ---------------------------------------------------------------------------------------------

def hash_bucket(id_col: Column, buckets: int = 100) -> Column:
    """Reproducible bucket of a row id: first 8 hex digits of md5(id) modulo ``buckets``."""
    return (F.conv(F.substring(F.md5(id_col.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets)


def split_train_test(df: DataFrame, id_col: str = "id", train_percent: int = TRAIN_PERCENT) -> DataFrame:
    """L1: ``split`` = train / test by a per-row hash (no shuffle, same split on any cluster)."""
    return df.withColumn("split", F.when(hash_bucket(F.col(id_col)) < train_percent, "train").otherwise("test"))


def scale_params(train: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """L2: per feature mean and population std of the training rows (one aggregation)."""
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}")]
    row = train.agg(*aggs)
    stack = ", ".join(f"'{f}', m_{f}, s_{f}" for f in features)
    return row.selectExpr(f"stack({len(features)}, {stack}) as (feature, mean, std)")


def standard_scale(df: DataFrame, params: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Apply ``scale_params`` like a fitted scaler: the 12 (mean, std) pairs are model
    parameters (24 numbers) fetched once and used as literals; rows never leave the executors."""
    p = {r["feature"]: (r["mean"], r["std"]) for r in params.collect()}
    out = df
    for f in features:
        mean, std = p[f]
        out = out.withColumn(f"{f}_scaled", (F.col(f) - F.lit(mean)) / F.lit(std) if std else F.lit(0.0))
    return out


# ---------------------------------------------------------------------------------------------
# L3-L8
# ---------------------------------------------------------------------------------------------

def failure_pipeline(features: list[str] = FEATURES, label: str = "label") -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="keep"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        RandomForestClassifier(featuresCol="features", labelCol=label, **FOREST, **LINEAGE),
    ])


def fit_parts(train: DataFrame, rows: int | None = None) -> DataFrame:
    """``train`` in parts of about ``rows`` rows, whatever the files it is read from look like; without ``rows`` in parts of
    ``FIT_ROWS``, or in more and smaller ones while they are few."""
    n = train.count()
    parts = -(-n // rows) if rows else max(-(-n // FIT_ROWS), min(FIT_PARTS, -(-n // FIT_LEAST)))
    if parts > 1:
        return train.repartition(parts, *train.columns)
    return train.coalesce(1) if rows else train


def train_failure_model(train: DataFrame, label: str = "label") -> PipelineModel:
    """L3: assembler -> scaler -> random forest (100 trees, depth 15, seed 42)."""
    ensure_checkpoint_dir(train.sparkSession)
    rows = fit_parts(train).persist()  # scaler, split points and forest pass over them in turn
    try:
        return failure_pipeline(label=label).fit(rows)
    finally:
        rows.unpersist()


def positive_probability(scored: DataFrame) -> Column:
    return vector_to_array(F.col("probability"))[1]


def predict_failure(model: PipelineModel, features: DataFrame, keep: list[str]) -> DataFrame:
    """Probability of failure, will_fail (p > 0.5), risk level and factors."""
    s = model.transform(spread(features))
    p = positive_probability(s)
    return s.select(*keep, p.alias("confidence"), (p > 0.5).alias("will_fail"), risk_level(p).alias("risk_level"),
                    risk_factors().alias("factors"))


def evaluate(model: PipelineModel, test: DataFrame, label: str = "label") -> DataFrame:
    """A7 over the model's predictions of ``test``."""
    s = model.transform(spread(test)).select(F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))
    return classifier_metrics(s)


def cross_validate_f1(train: DataFrame, id_col: str = "id", label: str = "label", folds: int = CV_FOLDS) -> DataFrame:
    """L4: F1 per hash fold (fit on the other folds), with the mean and +/- 2 std."""
    spark = train.sparkSession
    fold = hash_bucket(F.col(id_col), folds)
    data = train.withColumn("_fold", fold)
    rows = []
    for k in range(folds):  # k model fits; the data never leaves the cluster
        model = train_failure_model(data.filter(F.col("_fold") != k), label)
        m = evaluate(model, data.filter(F.col("_fold") == k), label).select("f1").first()
        rows.append((k, float(m["f1"])))
    df = spark.createDataFrame(rows, "fold int, f1 double")
    w = Window.partitionBy()
    return df.select("fold", "f1", F.avg("f1").over(w).alias("mean_f1"), (2 * F.stddev_pop("f1").over(w)).alias("two_std"))


def fit_with_cross_validator(train: DataFrame, label: str = "label", folds: int = CV_FOLDS, parallelism: int = 1):
    """L3 as the service configures it: a grid of one point, ``folds``-fold cross validation on
    the F1 of the positive class, then the forest refit on all training rows. Returns the
    ``CrossValidatorModel`` (``bestModel``, ``avgMetrics``). ``cross_validate_f1`` gives the
    same measurement on reproducible hash folds."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    ensure_checkpoint_dir(train.sparkSession)
    pipe = failure_pipeline(label=label)
    forest = pipe.getStages()[-1]
    grid = ParamGridBuilder().addGrid(forest.numTrees, [FOREST["numTrees"]]).build()
    evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0)
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds,
                        seed=FOREST["seed"], parallelism=parallelism)
    return cv.fit(fit_parts(train))


def feature_importance(model: PipelineModel, spark: SparkSession, features: list[str] = FEATURES) -> DataFrame:
    """Importances by feature name, sorted descending."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(features, [float(x) for x in imp])), "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature")


def top_features(importances: DataFrame, k: int = 5) -> DataFrame:
    """T4: the ``k`` most important features."""
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


def healing_decision(samples: DataFrame, label: str = "label", min_samples: int = MIN_HEALING_SAMPLES) -> dict:
    """A9 as a driver-side decision from one aggregate row."""
    r = samples.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("k"),
                    F.mode(F.col(label)).alias("mode")).first()
    n, k, mode = int(r["n"]), int(r["k"]), r["mode"]
    decision = "skip" if n < min_samples else ("majority_class" if k < 2 else "train")
    return {"n_samples": n, "n_classes": k, "majority": mode, "decision": decision}


def weighted_samples(samples: DataFrame, label: str = "label") -> DataFrame:
    """The distinct healing samples and how often each occurs (``weight``). Four of the five features are flags, a level and
    a constant and the fifth is a length, so they grow with the lengths found and not with the failures."""
    return samples.groupBy(*HEALING_FEATURES, label).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def train_healing_model(samples: DataFrame, label: str = "label") -> tuple[PipelineModel | None, dict]:
    """Skip below 50 samples; a single class -> majority rule (no model); else boosting
    (150 x 0.05, depth 4) on the five healing features with their own scaler. The scaler is fitted on all samples; boosting
    leaves none of them out in any round, so equal samples go through its passes as one of their weight, in parts of about
    ``HEALING_ROWS``."""
    samples = samples.persist()  # the decision, scaler and weights pass over them in turn
    held = weighted_samples(samples, label).persist()
    try:
        d = healing_decision(samples, label)
        if d["decision"] != "train":
            return None, d
        ensure_checkpoint_dir(samples.sparkSession)
        scaler = Pipeline(stages=[
            VectorAssembler(inputCols=HEALING_FEATURES, outputCol="raw_features", handleInvalid="keep"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        ]).fit(samples)
        boosting = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", **BOOSTING, **LINEAGE)
        return PipelineModel([*scaler.stages, boosting.fit(scaler.transform(fit_parts(held, HEALING_ROWS)))]), d
    finally:
        held.unpersist()
        samples.unpersist()


def predict_healing(model: PipelineModel | None, features: DataFrame, keep: list[str], decision: dict | None = None) -> DataFrame:
    """Probability that healing works; no model -> the majority class as 0/1, or 0.5."""
    if model is None:
        p = 0.5
        if decision and decision.get("decision") == "majority_class" and decision.get("majority") is not None:
            p = float(decision["majority"])
        return features.select(*keep, F.lit(p).alias("probability"))
    s = model.transform(features)
    return s.select(*keep, positive_probability(s).alias("probability"))


# ---------------------------------------------------------------------------------------------
# S11, S12, L9
# ---------------------------------------------------------------------------------------------

def save_models(spark: SparkSession, path: str, failure: PipelineModel, healing: PipelineModel | None,
                trained_at: str) -> None:
    """Failure model, healing model only when present, metadata beside them (shared FS)."""
    failure.write().overwrite().save(f"{path}/failure_model")
    if healing is not None:
        healing.write().overwrite().save(f"{path}/healing_model")
    meta = {"trained_at": trained_at, "feature_names": FEATURES, "version": MODEL_VERSION,
            "has_healing_model": healing is not None}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_models(spark: SparkSession, path: str) -> tuple[PipelineModel, PipelineModel | None, dict]:
    """The failure model is required; the healing model is optional."""
    failure = PipelineModel.load(f"{path}/failure_model")
    meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    healing = PipelineModel.load(f"{path}/healing_model") if meta.get("has_healing_model") else None
    return failure, healing, meta


def training_report(spark: SparkSession, failure_metrics: DataFrame, healing_metrics: DataFrame | None,
                    importances: DataFrame) -> DataFrame:
    """Report rows: four metrics per model (4 decimals) and the top-5 features."""
    def rows(m: DataFrame, model: str) -> DataFrame:
        return m.selectExpr(f"stack(4, 'accuracy', accuracy, 'precision', precision, 'recall', recall, 'f1', f1) as (metric, value)") \
                .select(F.lit(model).alias("section"), F.col("metric").alias("name"), F.round("value", 4).alias("value"))
    out = rows(failure_metrics, "failure_model")
    if healing_metrics is not None:
        out = out.unionByName(rows(healing_metrics, "healing_model"))
    top = top_features(importances).select(F.lit("top_features").alias("section"), F.col("feature").alias("name"),
                                           F.round("importance", 4).alias("value"))
    return out.unionByName(top)


def retrain_check(pairs: DataFrame, trained_at: str, as_of: str) -> DataFrame:
    """Accuracy on recent labelled predictions, model age, and the retrain decision."""
    m = classifier_metrics(pairs)
    age = (_dt.datetime.fromisoformat(as_of) - _dt.datetime.fromisoformat(trained_at)).total_seconds() / 3600
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return m.select(
        n.alias("samples"), "accuracy",
        (F.col("accuracy") < RETRAIN_ACCURACY).alias("accuracy_low"),
        F.lit(age).alias("model_age_hours"), F.lit(age > RETRAIN_MAX_AGE_HOURS).alias("model_stale"),
        (n >= RETRAIN_MIN_SAMPLES_CONFIG).alias("enough_samples"),
        (n >= RETRAIN_MIN_SAMPLES_README).alias("enough_samples_strict"),
        (((F.col("accuracy") < RETRAIN_ACCURACY) | F.lit(age > RETRAIN_MAX_AGE_HOURS))
         & (n >= RETRAIN_MIN_SAMPLES_CONFIG)).alias("retrain"),
    )
