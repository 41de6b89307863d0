"""Invariants of the model operators (SURVEY §5 (3))."""

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StringIndexer, TargetEncoder
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from cohortlens.operators import encode, models, stats
from cohortlens.plans.catalog import models as mq


@pytest.fixture(scope="module")
def frame(spark, sf_small):
    return mq.model_frame(spark, sf_small)


def test_auc_equals_spark_evaluator(spark, frame):
    d = frame.withColumn("s", F.col("Overall_Avg_Attendance") + F.col("c_acctbal") / 1000).dropna(subset=["s"])
    ours = stats.roc_auc(d, mq.RISK, "s").first().auc
    ev = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol=mq.RISK, metricName="areaUnderROC")
    assert ours == pytest.approx(ev.evaluate(d.withColumn(mq.RISK, F.col(mq.RISK).cast("double"))), abs=1e-9)


def test_target_encoder_matches_spark_ml(spark):
    rows = [(0, "a", 40.0), (1, "a", 60.0), (2, "b", 50.0), (3, "b", 70.0), (4, "b", 90.0), (5, "a", 80.0)]
    df = spark.createDataFrame(rows, "id long, c string, y double")
    ours = {r.c: r.encoding for r in encode.target_encoder(df, "c", "y", alpha=10.0).collect()}
    idx = StringIndexer(inputCol="c", outputCol="ci").fit(df).transform(df)
    te = TargetEncoder(inputCols=["ci"], outputCols=["e"], labelCol="y", targetType="continuous", smoothing=10.0)
    spark_enc = {r.c: r.e for r in te.fit(idx).transform(idx).select("c", "e").distinct().collect()}
    for k in ours:
        assert ours[k] == pytest.approx(spark_enc[k], abs=1e-9)


def test_linear_attribution_sums_to_prediction(spark, frame):
    train = frame.where("split = 'train'")
    m = models.assemble_model(mq.FEATURES, LinearRegression(labelCol=mq.TARGET, featuresCol="features")).fit(train)
    local, _ = models.linear_attribution(m, frame, mq.FEATURES, "c_custkey")
    tot = local.groupBy("c_custkey").agg(F.sum("contribution").alias("s"))
    pred = m.transform(frame).select("c_custkey", "prediction")
    icpt = m.stages[-1].intercept
    diff = tot.join(pred, "c_custkey").select(F.max(F.abs(F.col("s") + F.lit(icpt) - F.col("prediction")))).first()[0]
    assert diff < 1e-9


def test_blend_weights_must_sum_to_one(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert models.blend(df, {"a": 0.5, "b": 0.5}).first().blend == pytest.approx(1.5)
    with pytest.raises(ValueError):
        models.blend(df, {"a": 0.5, "b": 0.6})


def test_save_reload_identical(spark, frame, tmp_path):
    train = frame.where("split = 'train'")
    m = models.assemble_model(mq.FEATURES, GBTRegressor(maxIter=3, maxDepth=2, labelCol=mq.TARGET, featuresCol="features")).fit(train)
    r = models.save_reload_check(m, frame, str(tmp_path / "m"), "c_custkey").first()
    assert r.identical and r.max_abs_diff == 0.0


def test_smote_balances_classes(spark, frame):
    (d,) = mq._filled(frame, frame)
    out = models.smote(d, mq.FEATURES, mq.RISK, "c_custkey")
    sizes = {r[mq.RISK]: r["n"] for r in out.groupBy(mq.RISK).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(set(sizes.values())) == 1


def test_folds_side_by_side_equal_cross_validator(spark, frame):
    from cohortlens.operators import split

    d = split.kfold(frame, "c_custkey", 3)
    est = lambda: GBTRegressor(maxIter=3, maxDepth=2, seed=1)
    got = models.fold_scores(d, mq.FEATURES, mq.TARGET, est(), "fold", range(3)).first()
    want = models.cross_validate(d, mq.FEATURES, mq.TARGET, est(), None, "fold", k=3).first()
    assert (got.mean_r2, got.std_r2) == pytest.approx((want.mean_r2, want.std_r2), abs=1e-9)


def test_smote_refuses_a_single_row(spark):
    d = spark.createDataFrame([(1, 0.0, 1), (2, 1.0, 0), (3, 2.0, 0)], "id bigint, a double, y int")
    with pytest.raises(ValueError):
        models.smote(d, ["a"], "y", "id")


def test_cluster_shares_sum_to_one(spark, sf_small):
    from cohortlens.operators.segments import share_within
    from cohortlens.plans import fixtures as fx

    s = share_within(fx.order_people(spark, sf_small), "r_name", "o_orderstatus")
    tot = s.groupBy("r_name").agg(F.sum("share").alias("t")).collect()
    assert all(abs(r.t - 1.0) < 1e-12 for r in tot)


def test_customers_without_a_target_are_projected_and_clustered(spark, sf_small, frame, monkeypatch):
    lacking = F.when(F.col("c_custkey") % 4 != 0, F.col(mq.TARGET))
    some = frame.withColumn(mq.TARGET, lacking)
    monkeypatch.setattr(mq, "score_frame", lambda spark, sf: some)
    everyone = some.count()
    assert everyone > some.where(F.col(mq.TARGET).isNotNull()).count()
    assert mq.pca_projection(spark, sf_small).where("pc1 IS NOT NULL").count() == everyone
    assert mq.engagement_pca(spark, sf_small).where("Overall_Engagement_Score IS NOT NULL").count() == everyone
    assert mq.kmeans_profile(spark, sf_small).agg(F.sum("n")).first()[0] == everyone


def test_forest_with_node_ids_is_the_same(spark, frame, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    forest = lambda: RandomForestClassifier(numTrees=6, maxDepth=8, seed=42, labelCol=mq.RISK, featuresCol="features")
    train = frame.where("split = 'train'").repartition(2).cache()
    kept = models.with_node_ids(forest(), train.count())
    assert kept.getCacheNodeIds() and kept.getCheckpointInterval() == -1
    trees = [models.assemble_model(mq.FEATURES, f).fit(train).stages[-1].toDebugString.split("\n", 1)[1] for f in (forest(), kept)]
    assert trees[0] == trees[1]
    monkeypatch.setattr(models, "NODE_IDS", 4 * 6 * train.count() - 1)
    assert not models.with_node_ids(forest(), train.count()).getCacheNodeIds()


def test_classifier_compare_keeps_node_ids(spark, sf_small, frame, monkeypatch):
    seen = {}
    monkeypatch.setattr(mq, "model_frame", lambda spark, sf: frame)
    monkeypatch.setattr(mq.ml, "classifier_compare", lambda train, test, features, label, ests: (seen.update(ests), (train, None))[1])
    mq.classifier_compare(spark, sf_small)
    assert seen["random_forest"].getCacheNodeIds() and seen["random_forest"].getNumTrees() == 500
