"""Model queries (L1-L15, H6, M5): Spark ML over the customer feature table.

Model outputs are checked by row count and by the invariants in the tests
(reload equality, blend weights, attribution sums, shares); the one-feature
linear fit also has an exact SQL oracle (``regr_slope`` / ``regr_intercept``).
"""

from __future__ import annotations

import uuid

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from cohortlens.operators import models as ml
from cohortlens.operators import split as sp
from cohortlens.operators import stats
from cohortlens.operators.attribution import fit_linear, local_attribution
from cohortlens.operators.linear_cv import linear_cv
from cohortlens.operators.model_record import load_model, save_model
from cohortlens.plans.catalog.reshape import stage_features
from cohortlens.plans.registry import finish, register
from cohortlens.session import materialize, scratch_path
from cohortlens.sources.tables import load

FEATURES = [
    "Overall_Avg_Attendance",
    "Overall_Avg_Homework",
    "Overall_Avg_Participation",
    "Overall_Textbook_Access_Composite",
    "Attendance_Consistency",
    "Avg_Attendance_Secondary",
    "Avg_HW_Completion_Secondary",
    "c_acctbal",
    "c_nationkey",
]
TARGET = "Overall_Test_Score_Avg"
RISK = "at_risk"
#: Model sizes and search grids of the analysed average-score pipeline, and the sizes of its risk classifiers.
RF_TREES, RF_DEPTH = 200, 10
CLASSIFIER_TREES, CLASSIFIER_ROUNDS = 500, 500
GBT_ITER, GBT_DEPTH, GBT_STEP, GBT_SUBSAMPLE = 200, 5, 0.05, 0.8
LASSO_GRID = [10 ** (-3 + 4 * i / 19) for i in range(20)]
RIDGE_GRID = [10 ** (-3 + 6 * i / 19) for i in range(20)]
REPEATS = 10


def gbt_regressor(**more):
    return GBTRegressor(maxIter=GBT_ITER, maxDepth=GBT_DEPTH, stepSize=GBT_STEP, subsamplingRate=GBT_SUBSAMPLE, seed=42, **more)


def gbt_classifier(rounds=GBT_ITER, **more):
    return GBTClassifier(maxIter=rounds, maxDepth=GBT_DEPTH, stepSize=GBT_STEP, seed=42, **more)


def score_frame(spark, sf):
    """Every customer: features, target (null where it has none), risk label, split."""
    f = stage_features(spark, sf)
    f = f.select("c_custkey", *[F.col(c).cast("double").alias(c) for c in FEATURES], TARGET)
    f = f.withColumn(RISK, (F.col(TARGET) < 50).cast("int"))
    # the feature plan (wide pivot, 480 row-wise expressions) is cut here: the
    # estimators below scan it many times
    return materialize(sp.hash_split(f, "c_custkey", 0.2).hint("rebalance"))  # few rows: few partitions


def model_frame(spark, sf):
    """The customers of ``score_frame`` that have a target: models are fitted on these."""
    return score_frame(spark, sf).where(F.col(TARGET).isNotNull())


def _split(spark, sf):
    d = model_frame(spark, sf)
    return d.where(F.col("split") == "train"), d.where(F.col("split") == "test")


def _filled(train, *frames):
    """Frames with nulls of the features filled with the train medians."""
    imputer = Imputer(inputCols=FEATURES, outputCols=FEATURES, strategy="median").fit(train)
    return [imputer.transform(f) for f in frames]


# ---------------------------------------------------------------- L1
@register(
    "linear_regression",
    sql="""SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem
WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL""",
)
def linear_regression(spark, sf):
    """One-feature OLS with Spark ML (normal equation); equals regr_slope/intercept."""
    li = load(spark, sf, "lineitem").select("l_quantity", "l_extendedprice").dropna()
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(li)
    m = LinearRegression(featuresCol="features", labelCol="l_extendedprice", solver="normal", regParam=0.0).fit(v)
    return finish(
        spark.createDataFrame([(float(m.intercept), float(m.coefficients[0]))], "intercept double, slope double"), 4
    )


# ---------------------------------------------------------------- L2 / L7 / D12
@register("regularised_cv")
def regularised_cv(spark, sf):
    """Lasso and ridge over a log-spaced regParam grid, 5 folds (fold column from the id hash)."""
    d = sp.kfold(model_frame(spark, sf), "c_custkey", 5)
    grids = {"lasso": (1.0, LASSO_GRID), "ridge": (0.0, RIDGE_GRID)}
    return linear_cv(d, FEATURES, TARGET, "fold", grids).select("params", "mean_r2", "std_r2", "model")


_RIDGE_VALUES = [0.0, 1.0, 100.0, 5000.0, 20000.0]


@register(
    "ridge_cv_pair",
    sql=f"""
WITH rows_ AS (SELECT l_orderkey % 5 AS fold, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_extendedprice::DOUBLE AS y FROM lineitem),
part AS (SELECT h.fold AS held, r.* FROM rows_ r JOIN (SELECT DISTINCT fold FROM rows_) h ON r.fold <> h.fold),
fit AS (SELECT held, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(y) AS sy,
  corr(a, b) AS rab, corr(a, y) AS ray, corr(b, y) AS rby FROM part GROUP BY held),
grid AS (SELECT unnest({_RIDGE_VALUES}::DOUBLE[]) AS reg),
coef AS (SELECT held, reg, my, ma, mb, 1 + reg / sy AS d,
  (ray * (1 + reg / sy) - rab * rby) / ((1 + reg / sy) ** 2 - rab ** 2) * sy / sa AS wa,
  (rby * (1 + reg / sy) - rab * ray) / ((1 + reg / sy) ** 2 - rab ** 2) * sy / sb AS wb FROM fit, grid),
score AS (SELECT held, reg, 1 - sum((y - my - wa * (a - ma) - wb * (b - mb)) ** 2) / (count(*) * var_pop(y)) AS r2
  FROM coef JOIN rows_ ON fold = held GROUP BY held, reg)
SELECT reg, round(avg(r2), 6) AS mean_r2, round(stddev_pop(r2), 6) AS std_r2 FROM score GROUP BY reg""",
)
def ridge_cv_pair(spark, sf):
    """Ridge of two features over a few penalties, 5 folds by key: the closed form in SQL."""
    li = load(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_extendedprice", (F.col("l_orderkey") % 5).alias("fold"))
    got = linear_cv(li, ["l_quantity", "l_discount"], "l_extendedprice", "fold", {"ridge": (0.0, _RIDGE_VALUES)})
    return finish(got.select("reg", "mean_r2", "std_r2"), 6)


@register("cv_scores")
def cv_scores(spark, sf):
    """5-fold CV R² (mean ± std) of the GBT, the test R² and the generalisation label."""
    train, test = _split(spark, sf)
    whole = ml.assemble_model(FEATURES, gbt_regressor(labelCol=TARGET, featuresCol="features"))
    cv, model = ml.side_by_side(
        spark,
        [
            lambda: ml.fold_scores(sp.kfold(train, "c_custkey", 5), FEATURES, TARGET, gbt_regressor(), "fold", range(5)),
            lambda: whole.fit(train),
        ],
    )
    tr = stats.regression_metrics(model.transform(train), TARGET, "prediction").select(F.col("r2").alias("train_r2"))
    te = stats.regression_metrics(model.transform(test), TARGET, "prediction").select(F.col("r2").alias("test_r2"))
    j = cv.crossJoin(tr).crossJoin(te).withColumn("gap", F.col("test_r2") - F.col("mean_r2"))
    return finish(j.withColumn("generalisation", stats.generalisation_label("gap")))


# ---------------------------------------------------------------- L3 / L4 / L6
def _regressors():
    return {
        "linear": LinearRegression(),
        "random_forest": RandomForestRegressor(numTrees=RF_TREES, maxDepth=RF_DEPTH, seed=42),
        "gradient_boosting": gbt_regressor(),
    }


@register("rf_gbt_compare")
def rf_gbt_compare(spark, sf):
    train, test = _split(spark, sf)
    table, _ = ml.train_compare(train, test, FEATURES, TARGET, _regressors())
    return finish(table)


# ---------------------------------------------------------------- L5
@register("classifier_compare")
def classifier_compare(spark, sf):
    """Risk classifiers fitted on the stratified, SMOTE-balanced train rows."""
    d = model_frame(spark, sf).withColumn("_order", sp.hash_order("c_custkey"))
    d = sp.stratified_split(d.drop("split"), RISK, ["_order", "c_custkey"], 0.2).drop("_order")
    train, test = _filled(d.where("split = 'train'"), d.where("split = 'train'"), d.where("split = 'test'"))
    train = materialize(ml.smote(train, FEATURES, RISK, "c_custkey").hint("rebalance"))  # few rows: few partitions
    forest = RandomForestClassifier(numTrees=CLASSIFIER_TREES, maxDepth=RF_DEPTH, seed=42)
    ests = {
        "logistic": LogisticRegression(maxIter=100),
        "random_forest": ml.with_node_ids(forest, train.count()),
        "gradient_boosting": gbt_classifier(CLASSIFIER_ROUNDS),
    }
    table, _ = ml.classifier_compare(train, test, FEATURES, RISK, ests)
    return finish(table)


# ---------------------------------------------------------------- M5
@register("smote")
def smote(spark, sf):
    """Train split oversampled to balanced risk classes; returns class sizes."""
    train, _ = _split(spark, sf)
    (filled,) = _filled(train, train)
    bal = ml.smote(filled, FEATURES, RISK, "c_custkey")
    return bal.groupBy(RISK, "synthetic").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- L8
@register("importance")
def importance(spark, sf):
    train, _ = _split(spark, sf)
    est = RandomForestRegressor(numTrees=RF_TREES, maxDepth=RF_DEPTH, seed=42, labelCol=TARGET, featuresCol="features")
    model = ml.assemble_model(FEATURES, est).fit(train)
    return finish(ml.importance(model, FEATURES))


# ---------------------------------------------------------------- L9
@register("permutation_importance")
def permutation_importance(spark, sf):
    train, test = _split(spark, sf)
    est = gbt_regressor(labelCol=TARGET, featuresCol="features")
    model = ml.assemble_model(FEATURES, est).fit(train)
    return finish(ml.permutation_importance(model, test, "c_custkey", FEATURES, TARGET, repeats=REPEATS))


# ---------------------------------------------------------------- L10
@register("linear_attribution")
def linear_attribution(spark, sf):
    train, test = _split(spark, sf)
    model = ml.assemble_model(FEATURES, LinearRegression(labelCol=TARGET, featuresCol="features")).fit(train)
    _, glob = ml.linear_attribution(model, test, FEATURES, "c_custkey")
    return finish(glob)


@register(
    "linear_attribution_local",
    sql="""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_extendedprice::DOUBLE AS y FROM lineitem),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS bby FROM x),
w AS (SELECT *, (ay * vb - bby * ab) / (va * vb - ab * ab) AS wa, (bby * va - ay * ab) / (va * vb - ab * ab) AS wb FROM m),
c AS (SELECT l_orderkey, l_linenumber, wa * (a - ma) AS ca, wb * (b - mb) AS cb FROM x, w)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(ca) >= abs(cb) THEN 'l_quantity' ELSE 'l_discount' END AS feature,
       round(CASE WHEN abs(ca) >= abs(cb) THEN ca ELSE cb END, 4) AS contribution, round(greatest(abs(ca), abs(cb)) / (abs(ca) + abs(cb)), 4) AS share FROM c""",
)
def linear_attribution_local(spark, sf):
    """Every line's largest contribution to its predicted price (two-feature least squares)."""
    li = load(spark, sf, "lineitem")
    fit = fit_linear(li, ["l_quantity", "l_discount"], "l_extendedprice")
    return finish(local_attribution(li, fit, ["l_orderkey", "l_linenumber"], top=1).drop("rank"), 4)


# ---------------------------------------------------------------- L11 / D11
@register("kmeans_profile")
def kmeans_profile(spark, sf):
    d = score_frame(spark, sf)  # the target only ranks the labels
    _, prof, sil = ml.kmeans_profile(d, FEATURES, TARGET, k=3)
    return finish(prof.withColumn("silhouette", F.lit(float(sil))))


# ---------------------------------------------------------------- L13
@register("pca_projection")
def pca_projection(spark, sf):
    return finish(ml.pca_projection(score_frame(spark, sf), FEATURES, 2, keep=["c_custkey"]))


# ---------------------------------------------------------------- H6
@register("engagement_pca")
def engagement_pca(spark, sf):
    eng = ["Overall_Avg_Attendance", "Overall_Avg_Homework", "Overall_Avg_Participation"]
    return finish(ml.engagement_pca(score_frame(spark, sf), eng, keep=["c_custkey"]))


# ---------------------------------------------------------------- L14
@register("blend")
def blend(spark, sf):
    """Blend .5/.3/.2 of GBT, RF and linear predictions, with test metrics of each and of the blend."""
    train, test = _split(spark, sf)
    _, fitted = ml.train_compare(train, test, FEATURES, TARGET, _regressors())
    scored, keep = test, test.columns
    for name in ("gradient_boosting", "random_forest", "linear"):  # chained on the same rows: no join
        keep = [*keep, f"p_{name}"]
        scored = fitted[name].transform(scored).withColumnRenamed("prediction", f"p_{name}").select(*keep)
    b = ml.blend(scored, {"p_gradient_boosting": 0.5, "p_random_forest": 0.3, "p_linear": 0.2})
    out = None
    for c in ("p_gradient_boosting", "p_random_forest", "p_linear", "blend"):
        m = stats.regression_metrics(b, TARGET, c).withColumn("model", F.lit(c))
        out = m if out is None else out.unionByName(m)
    return finish(out)


# ---------------------------------------------------------------- L15
@register("save_reload_check")
def save_reload_check(spark, sf):
    """A model stored with its record, loaded again through the record's checks."""
    train, test = _split(spark, sf)
    model = ml.assemble_model(FEATURES, gbt_regressor(labelCol=TARGET, featuresCol="features")).fit(train)
    path = scratch_path(spark, f"models/gbt_{uuid.uuid4().hex}")
    save_model(model, path, "gradient_boosting", FEATURES, TARGET, train)
    again, _ = load_model(path, test, TARGET, FEATURES)
    return finish(ml.compare_predictions(model, again, test, "c_custkey"))