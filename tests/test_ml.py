"""Model invariants (numbers differ from any other library; the rules must hold)."""

import threading

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from runlens.operators import ml as ML
from runlens.operators import stats as ST
from runlens.plans import q_ml
from runlens.plans.session import checkpoint_path


def test_failure_model_beats_majority_and_reloads(spark, sf):
    m = q_ml.models(spark, sf)
    test = m["test"]
    metrics = ML.evaluate(m["failure"], test).first()
    pos = test.agg(F.avg("label")).first()[0]
    assert metrics.accuracy > max(pos, 1 - pos)
    imp = ML.feature_importance(m["failure"], spark).collect()
    assert len(imp) == 12 and abs(sum(r.importance for r in imp) - 1.0) < 1e-6
    path = checkpoint_path(spark, "test-models")
    ML.save_models(spark, path, m["failure"], m["healing"], "2024-02-01 00:00:00")
    failure, healing, meta = ML.load_models(spark, path)
    a = m["failure"].transform(test).select("id", "prediction")
    b = failure.transform(test).select("id", F.col("prediction").alias("p2"))
    assert a.join(b, "id").filter(F.col("prediction") != F.col("p2")).count() == 0
    assert meta["feature_names"] == ML.FEATURES and (healing is None) == (m["healing"] is None)


def test_healing_decision_rules(spark):
    few = spark.createDataFrame([(1,)] * 10, "label int")
    one = spark.createDataFrame([(1,)] * 60, "label int")
    two = spark.createDataFrame([(i % 2,) for i in range(60)], "label int")
    assert ML.healing_decision(few)["decision"] == "skip"
    d = ML.healing_decision(one)
    assert d["decision"] == "majority_class" and d["majority"] == 1
    assert ML.healing_decision(two)["decision"] == "train"
    feats = spark.createDataFrame([(1,)], "log_id int")
    assert ML.predict_healing(None, feats, ["log_id"]).first().probability == 0.5


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    r = ST.classifier_metrics(df).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_risk_levels(spark):
    df = spark.createDataFrame([(0.85,), (0.8,), (0.6,), (0.5,), (0.2,), (0.19,)], "p double")
    got = [r.r for r in df.select(ML.risk_level(F.col("p")).alias("r")).collect()]
    assert got == ["very_high", "very_high", "high", "medium", "low", "very_low"]


def test_cross_validator_path(spark, sf):
    from runlens.sources.tables import tables
    d = ML.split_train_test(q_ml.training_frame(tables(spark, sf)))
    cvm = ML.fit_with_cross_validator(d.filter("split = 'train'"))
    assert len(cvm.avgMetrics) == 1 and cvm.avgMetrics[0] > 0.8
    m = ML.evaluate(cvm.bestModel, d.filter("split = 'test'")).first()
    assert m.f1 > 0.8


def test_a_fit_reads_bounded_parts(spark, monkeypatch):
    """One file part of 400 rows, half of them alike: a fit gets them all, in parts of about FIT_ROWS."""
    monkeypatch.setattr(ML, "FIT_ROWS", 50)
    train = spark.range(400).select(F.when(F.col("id") < 200, F.col("id")).alias("id"), (F.col("id") % 2).cast("int").alias("label"),
                                    *[(F.col("id") % (i + 2)).cast("double").alias(f) for i, f in enumerate(ML.FEATURES)]).coalesce(1)
    seen = {}

    class Fake:
        def fit(self, rows):
            seen["parts"] = [len(p) for p in rows.rdd.glom().collect()]
            seen["rows"] = sorted(map(repr, rows.collect()))
    monkeypatch.setattr(ML, "failure_pipeline", lambda label: Fake())
    ML.train_failure_model(train)
    assert len(seen["parts"]) == 8 and max(seen["parts"]) < 150
    assert seen["rows"] == sorted(map(repr, train.collect()))
    monkeypatch.setattr(ML, "FIT_ROWS", 400)
    ML.train_failure_model(train)
    assert seen["parts"] == [400]


def test_scoring_deals_rows_out(spark):
    """Models score rows of one large part in as many tasks as their size asks for, copies too."""
    one = spark.range(1, numPartitions=1).select(F.explode(F.expr("sequence(1, 300)")).alias("k")).select(
        (F.col("k") % 3).alias("id"), F.lit(1).alias("label"), *[F.lit(1.0).alias(f) for f in ML.FEATURES])

    class Same:
        def transform(self, rows):
            seen.append(rows)
            return rows.withColumn("probability", array_to_vector(F.array(F.lit(0.4), F.lit(0.6)))).withColumn("prediction", F.lit(1.0))
    seen = []
    p = ML.predict_failure(Same(), one, ["id"])
    assert p.count() == 300 and ML.evaluate(Same(), one).first().accuracy == 1.0
    for rows in seen:
        assert "RebalancePartitions" in rows._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(rows.collect()) == sorted(one.collect())


def test_a_fit_of_few_rows_is_not_one_part(spark, monkeypatch):
    """Fewer rows than FIT_ROWS are parts of FIT_LEAST rows, up to FIT_PARTS of them; more rows are parts of FIT_ROWS."""
    monkeypatch.setattr(ML, "FIT_LEAST", 100, raising=False)
    monkeypatch.setattr(ML, "FIT_ROWS", 2000)
    parts = lambda n: ML.fit_parts(spark.range(n).coalesce(1)).rdd.getNumPartitions()
    assert [parts(n) for n in (100, 1000, 2400, 5000, 60000)] == [1, 10, 24, 24, 30]
    rows = ML.fit_parts(spark.range(1000).coalesce(1)).rdd.glom().collect()
    assert max(map(len, rows)) < 200 and sorted(r.id for p in rows for r in p) == list(range(1000))


def test_healing_samples_are_computed_once(spark, monkeypatch):
    """The analysis behind the samples runs once, not again for the decision, the scaler, the split points and the boosting."""
    monkeypatch.setitem(ML.BOOSTING, "maxIter", 2)
    seen = spark.sparkContext.accumulator(0)

    def row(i):
        seen.add(1)
        return (i % 2, *[float((i + k) % (k + 2)) for k in range(len(ML.HEALING_FEATURES))])
    samples = spark.createDataFrame(spark.sparkContext.parallelize(range(200), 2).map(row),
                                    "label int, " + ", ".join(f"{f} double" for f in ML.HEALING_FEATURES))
    model, decision = ML.train_healing_model(samples)
    assert decision["n_samples"] == 200 and model is not None
    assert seen.value == 200


def test_boosting_passes_over_distinct_samples(spark, monkeypatch):
    """Equal healing samples are one row of their weight in the boosting, and the model is that of MLlib over all rows."""
    monkeypatch.setitem(ML.BOOSTING, "maxIter", 5)
    names = ML.HEALING_FEATURES
    rows = [(int(i % 7 < 3 + i % 2), float(i % 2), float(i % 5 * 40), 0.0, float(i % 3), 1.0) for i in range(600)]
    samples = spark.createDataFrame(rows, "label int, " + ", ".join(f"{f} double" for f in names))
    weights = []
    fit = GBTClassifier.fit

    def seen(self, data, *more):
        weights.extend(r.weight for r in data.select("weight").collect())
        return fit(self, data, *more)
    monkeypatch.setattr(GBTClassifier, "fit", seen)
    model, decision = ML.train_healing_model(samples)
    monkeypatch.undo()
    assert decision["n_samples"] == 600 and len(weights) == len(set(rows)) < 100 and sum(weights) == 600
    scaler = model.stages[1]
    means = samples.agg(*[F.avg(f) for f in names]).first()
    assert all(abs(a - b) < 1e-9 for a, b in zip(scaler.mean.toArray(), means))
    ready = model.stages[1].transform(model.stages[0].transform(samples))
    plain = GBTClassifier(featuresCol="features", labelCol="label", **{**ML.BOOSTING, "maxIter": 5}, **ML.LINEAGE).fit(ready)
    a = [r.p for r in model.transform(samples).select(vector_to_array("probability")[1].alias("p")).collect()]
    b = [r.p for r in plain.transform(ready).select(vector_to_array("probability")[1].alias("p")).collect()]
    assert len(set(a)) > 1 and max(abs(x - y) for x, y in zip(a, b)) < 1e-9


def test_both_models_are_fitted_at_once(spark, sf, monkeypatch):
    """Neither fit waits for the other: each one here ends only when the other has begun."""
    both = threading.Barrier(2, timeout=60)

    def forest(train):
        both.wait()
        return "forest"

    def boosting(samples):
        both.wait()
        return "boosting", {"decision": "train"}
    monkeypatch.setattr(q_ml, "_MODELS", {})
    monkeypatch.setattr(ML, "train_failure_model", forest)
    monkeypatch.setattr(ML, "train_healing_model", boosting)
    m = q_ml.models(spark, sf)
    assert (m["failure"], m["healing"], m["decision"]) == ("forest", "boosting", {"decision": "train"})
