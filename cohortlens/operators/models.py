"""Model training, comparison, importance, clustering and persistence.

Everything is Spark ML over DataFrames: a ``Pipeline`` of ``Imputer`` (train
medians, T10) -> ``VectorAssembler`` -> ``StandardScaler`` -> estimator.  Metrics
are aggregate expressions over the scored DataFrame (``stats``), so evaluation
is one distributed pass per model.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import (
    PCA,
    Imputer,
    StandardScaler,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from cohortlens.operators import stats
from cohortlens.operators.neighbours import nearest_neighbours
from cohortlens.operators.sizing import broadcast_if_small, one_row
from cohortlens.session import materialize
from cohortlens.sources.prepare import row_positions


def assemble_model(features: Sequence[str], estimator=None, impute: bool = True, with_mean: bool = True) -> Pipeline:
    """Spark ML stages: Imputer(median) -> assemble -> standardise (-> estimator)."""
    stages = []
    cols = list(features)
    if impute:
        imp_out = [f"{c}__imp" for c in cols]
        stages.append(Imputer(inputCols=cols, outputCols=imp_out, strategy="median"))
        cols = imp_out
    stages.append(VectorAssembler(inputCols=cols, outputCol="raw_features", handleInvalid="keep"))
    stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=with_mean, withStd=True))
    if estimator is not None:
        stages.append(estimator)
    return Pipeline(stages=stages)


def side_by_side(spark: SparkSession, work: Sequence[Callable[[], object]]) -> list:
    """Results of independent fits, whose jobs run at the same time: between the many
    small passes of one fit most of a cluster idles."""
    with ThreadPool(max(len(work), 1)) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), work, chunksize=1)


#: Bytes of node ids, 4 a row and tree, up to which a forest keeps them; Spark holds up to three versions.
NODE_IDS = 2 << 30


def with_node_ids(forest, rows: int):
    """A forest that keeps the node of every row in every tree, where these are few enough
    for the executors' memory: without, each level sends each row down each tree again.  The
    fitted model is the same.  Nothing is written: a dozen levels are a short lineage."""
    if rows * forest.getNumTrees() * 4 > NODE_IDS:
        return forest
    return forest.setCacheNodeIds(True).setCheckpointInterval(-1)


def train_compare(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    label: str,
    estimators: Mapping[str, object],
) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Fit every estimator in the same pipeline, score the test
    split, return ``(model, n, r2, mae, rmse, mean_pct_error)`` rows and the
    fitted models; the best model is the first by r2 descending."""
    fitted = _fitted(train, features, label, estimators)
    out = None
    for name, model in fitted.items():
        m = stats.regression_metrics(model.transform(test), label, "prediction").withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out.select("model", "n", "r2", "mae", "rmse", "mean_pct_error"), fitted


def _fitted(train: DataFrame, features: Sequence[str], label: str, estimators: Mapping[str, object]) -> dict[str, PipelineModel]:
    """Every estimator fitted in the same pipeline, side by side."""
    pipes = [assemble_model(features, est.setLabelCol(label).setFeaturesCol("features")) for est in estimators.values()]
    models = side_by_side(train.sparkSession, [lambda pipe=pipe: pipe.fit(train) for pipe in pipes])
    return dict(zip(estimators, models, strict=True))


def classifier_compare(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    label: str,
    estimators: Mapping[str, object],
    threshold: float = 0.5,
) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Fit classifiers, score the positive-class probability on the test
    split; ``(model, auc, accuracy, precision, recall, f1)`` with exact AUC."""
    fitted = _fitted(train, features, label, estimators)
    out = None
    for name, model in fitted.items():
        scored = model.transform(test).withColumn("p1", vector_to_array("probability")[1])
        scored = scored.withColumn("pred", (F.col("p1") >= threshold).cast("int"))
        auc = stats.roc_auc(scored, label, "p1").select("auc")
        rep = stats.classification_report(scored, label, "pred").select("accuracy", "precision", "recall", "f1")
        m = auc.crossJoin(rep).withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out.select("model", "auc", "accuracy", "precision", "recall", "f1"), fitted


def cross_validate(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    estimator,
    grid: Mapping[str, Sequence] | None = None,
    fold_col: str | None = None,
    k: int = 5,
    parallelism: int = 2,
    seed: int = 42,
) -> DataFrame:
    """``CrossValidator`` (R², k folds, optional user fold column) over
    a parameter grid; one row per grid point with mean and std of the fold R²."""
    est = estimator.setLabelCol(label).setFeaturesCol("features")
    pipe = assemble_model(features, est)
    builder = ParamGridBuilder()
    for pname, values in (grid or {}).items():
        builder = builder.addGrid(est.getParam(pname), list(values))
    maps = builder.build()
    cv = CrossValidator(
        estimator=pipe,
        estimatorParamMaps=maps,
        evaluator=RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="r2"),
        numFolds=k,
        parallelism=parallelism,
        seed=seed,
        collectSubModels=False,
    )
    if fold_col:
        cv = cv.setFoldCol(fold_col)
    model = cv.fit(df)
    std = list(model.stdMetrics) if model.stdMetrics else [float("nan")] * len(maps)
    rows = []
    for i, pm in enumerate(maps):
        params = ", ".join(f"{p.name}={v}" for p, v in pm.items()) or "default"
        rows.append((params, float(model.avgMetrics[i]), float(std[i])))
    return df.sparkSession.createDataFrame(rows, "params string, mean_r2 double, std_r2 double")


def fold_scores(df: DataFrame, features: Sequence[str], label: str, estimator, fold_col: str, folds: Sequence[int]) -> DataFrame:
    """Mean and population deviation of the R² on the fold left out, one fit a
    fold.  ``CrossValidator`` fits one fold after the other; boosted trees leave most
    of a cluster idle then, so the folds' jobs run side by side."""
    pipe = assemble_model(features, estimator.setLabelCol(label).setFeaturesCol("features"))
    evaluator = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="r2")

    def score(fold: int) -> float:
        model = pipe.copy().fit(df.where(F.col(fold_col) != fold))
        return evaluator.evaluate(model.transform(df.where(F.col(fold_col) == fold)))

    got = side_by_side(df.sparkSession, [lambda fold=fold: score(fold) for fold in folds])
    row = ("default", float(np.mean(got)), float(np.std(got)))
    return df.sparkSession.createDataFrame([row], "params string, mean_r2 double, std_r2 double")


def importance(model: PipelineModel, features: Sequence[str], top: int | None = None) -> DataFrame:
    """Tree ``featureImportances`` or |coefficients| zipped to feature names,
    with their rank (1 = largest; ties by name) and, with ``top``, only the first."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        vals = last.featureImportances.toArray().tolist()
    else:
        vals = [abs(v) for v in last.coefficients.toArray().tolist()]
    spark = SparkSession.getActiveSession()
    ranked = sorted(zip(features, map(float, vals)), key=lambda x: (-x[1], x[0]))[:top]
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(ranked)], "feature string, importance double, rank int")


def permutation_importance(
    model: PipelineModel,
    test: DataFrame,
    id_col: str,
    features: Sequence[str],
    label: str,
    repeats: int = 10,
    seed: int = 42,
) -> DataFrame:
    """R² drop when one feature's values are replaced by those of another row.

    Rows get global positions in a hashed order; for repeat r the partner of
    position p is ``(p + shift_r) mod n`` (an equi-join on position, no global
    shuffle of a column).  All features of a repeat are scored in one pass:
    the rows are stacked once per feature (a broadcast p-row feature table),
    the feature is swapped, and metrics are grouped by feature."""
    base = stats.regression_metrics(model.transform(test), label, "prediction").select(F.col("r2").alias("base_r2"))
    d = test.withColumn("_h", F.xxhash64(F.col(id_col), F.lit(seed)))
    pos = row_positions(d, ["_h", id_col], "_pos")
    n_row = one_row(pos.agg(F.count(F.lit(1)).alias("_n")))
    feats_tbl = test.sparkSession.createDataFrame([(i, f) for i, f in enumerate(features)], "_k int, feature string")
    out = None
    for r in range(repeats):
        shift = 1 + (r * 7919) % 104729
        p = pos.crossJoin(n_row).withColumn("_ppos", F.pmod(F.col("_pos") - 1 + F.lit(shift), F.col("_n")) + 1)
        partner = pos.select(F.col("_pos").alias("_ppos"), *[F.col(f).alias(f"_p_{f}") for f in features])
        j = p.join(partner, "_ppos").crossJoin(F.broadcast(feats_tbl))
        swapped = j.withColumns(
            {f: F.when(F.col("_k") == i, F.col(f"_p_{f}")).otherwise(F.col(f)) for i, f in enumerate(features)}
        )
        m = stats.regression_metrics(model.transform(swapped), label, "prediction", ["feature"]).select(
            "feature", F.col("r2").alias("perm_r2")
        )
        out = m.withColumn("repeat", F.lit(r)) if out is None else out.unionByName(m.withColumn("repeat", F.lit(r)))
    agg = out.groupBy("feature").agg(F.avg("perm_r2").alias("mean_perm_r2"), F.stddev_samp("perm_r2").alias("std_perm_r2"))
    return agg.crossJoin(one_row(base)).select(
        "feature", (F.col("base_r2") - F.col("mean_perm_r2")).alias("importance"), "std_perm_r2"
    )


def linear_attribution(model: PipelineModel, df: DataFrame, features: Sequence[str], id_col: str) -> tuple[DataFrame, DataFrame]:
    """Exact additive attribution of a linear model on standardised
    features: contribution_i = coef_i · z_i (z centred, so the contributions
    sum to prediction - intercept).  Returns (per-row long table, global mean |contribution|)."""
    coef = model.stages[-1].coefficients.toArray().tolist()
    scored = model.transform(df).withColumn("_z", vector_to_array("features"))
    cells = [
        F.struct(F.lit(f).alias("feature"), (F.lit(float(c)) * F.col("_z")[i]).alias("contribution"))
        for i, (f, c) in enumerate(zip(features, coef))
    ]
    local = scored.select(id_col, F.explode(F.array(*cells)).alias("c")).select(id_col, "c.*")
    glob = local.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
    return local, glob


def kmeans_profile(
    df: DataFrame,
    features: Sequence[str],
    value: str,
    k: int = 3,
    seed: int = 42,
    labels: Sequence[str] = ("High", "Medium", "Low"),
) -> tuple[DataFrame, DataFrame, float]:
    """K-means (k-means|| init) on standardised features; clusters
    named by mean ``value`` rank; returns (rows with cluster label, profile
    table, silhouette).  Spark's silhouette is the squared-Euclidean form."""
    pipe = assemble_model(features, KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster"))
    model = pipe.fit(df)
    scored = model.transform(df)
    sil = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(scored)
    from cohortlens.operators.segments import label_rows, rank_labels

    ranked = rank_labels(scored, "cluster", value, labels)
    rows = label_rows(scored, ranked, "cluster", "cluster_label")
    prof = rows.groupBy("cluster", "cluster_label").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias(f"mean_{value}"), *[F.avg(f).alias(f"mean_{f}") for f in features]
    )
    return rows, prof, sil


def pca_projection(df: DataFrame, features: Sequence[str], k: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """Rows projected on the first k principal components of the
    standardised (centred) features; each component's sign is fixed so its
    loadings sum to a positive number."""
    pipe = assemble_model(features, PCA(k=k, inputCol="features", outputCol="pcs"))
    model = pipe.fit(df)
    pc = model.stages[-1].pc.toArray()
    signs = [1.0 if pc[:, j].sum() >= 0 else -1.0 for j in range(k)]
    out = model.transform(df).withColumn("_pcs", vector_to_array("pcs"))
    return out.select(*keep, *[(F.lit(signs[j]) * F.col("_pcs")[j]).alias(f"pc{j + 1}") for j in range(k)])


def engagement_pca(df: DataFrame, features: Sequence[str], out: str = "Overall_Engagement_Score", keep: Sequence[str] = ()) -> DataFrame:
    """H6: first principal component of the centred (unscaled, as sklearn's PCA)
    engagement columns, sign-fixed, min-max scaled to 0-100."""
    pipe = Pipeline(
        stages=[
            Imputer(inputCols=list(features), outputCols=[f"{c}__imp" for c in features], strategy="median"),
            VectorAssembler(inputCols=[f"{c}__imp" for c in features], outputCol="raw_features"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=False),
            PCA(k=1, inputCol="features", outputCol="pcs"),
        ]
    )
    model = pipe.fit(df)
    pc = model.stages[-1].pc.toArray()
    sign = 1.0 if pc[:, 0].sum() >= 0 else -1.0
    s = model.transform(df).withColumn("_s", F.lit(sign) * vector_to_array("pcs")[0])
    mm = one_row(s.agg(F.min("_s").alias("_mn"), F.max("_s").alias("_mx")))
    j = s.crossJoin(mm)
    return j.select(*keep, (100 * (F.col("_s") - F.col("_mn")) / (F.col("_mx") - F.col("_mn"))).alias(out))


def blend(df: DataFrame, predictions: Mapping[str, float], out: str = "blend") -> DataFrame:
    """Weighted sum of prediction columns (weights must sum to 1)."""
    total = sum(predictions.values())
    if not math.isclose(total, 1.0, abs_tol=1e-9):
        raise ValueError(f"blend weights sum to {total}, not 1")
    expr = None
    for c, w in predictions.items():
        t = F.col(c) * F.lit(float(w))
        expr = t if expr is None else expr + t
    return df.withColumn(out, expr)


def save_reload_check(model: PipelineModel, df: DataFrame, path: str, id_col: str, pred_col: str = "prediction") -> DataFrame:
    """Save, reload, score both, join by id; max / mean |difference| and
    whether the predictions are identical."""
    model.write().overwrite().save(path)
    return compare_predictions(model, PipelineModel.load(path), df, id_col, pred_col)


def compare_predictions(model: PipelineModel, again: PipelineModel, df: DataFrame, id_col: str, pred_col: str = "prediction") -> DataFrame:
    a = model.transform(df).select(id_col, F.col(pred_col).alias("_a"))
    b = again.transform(df).select(id_col, F.col(pred_col).alias("_b"))
    j = a.join(b, id_col)
    d = F.abs(F.col("_a") - F.col("_b"))
    return j.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(d).alias("max_abs_diff"),
        F.avg(d).alias("mean_abs_diff"),
        F.bool_and(F.col("_a") == F.col("_b")).alias("identical"),
    )


def standardised_neighbours(df: DataFrame, features: Sequence[str], id_col: str, k: int) -> DataFrame:
    """``_a, _b, dist, _j``: each row's k nearest by the standardised features, exactly."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="error"), StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True)]
    scaled = Pipeline(stages=stages).fit(df).transform(df).select(F.col(id_col).alias("_a"), vector_to_array("_std").alias("_x"))
    names = [f"x{i}" for i in range(len(features))]
    return nearest_neighbours(scaled.select("_a", *[F.col("_x")[i].alias(c) for i, c in enumerate(names)]), names, "_a", k)


def smote(df: DataFrame, features: Sequence[str], label: str, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """M5: SMOTE oversampling of the minority class as a distributed job.

    Synthetic rows are ``x + u · (x_nn - x)`` with x_nn one of the k nearest
    minority rows (``standardised_neighbours``) and u a hash of (id, draw), made
    round-robin over each row's neighbours until the classes are equal.  Returns
    the original rows plus the synthetic ones (``synthetic`` = 1).  Features must
    not be null (fill them with the train medians); a minority of one row can't
    be oversampled.  Both are errors."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    lab = counts.orderBy("_n", label).first()  # two-row table: the minority label
    minority, n_min = lab[0], lab[1]
    need = counts.agg(F.max("_n")).first()[0] - n_min
    if need <= 0:
        return df.withColumn("synthetic", F.lit(0))
    if n_min < 2:
        raise ValueError(f"class {minority!r} has {n_min} row(s): no neighbours to interpolate with")
    mino = df.where(F.col(label) == F.lit(minority))
    nn = materialize(standardised_neighbours(mino, features, id_col, k))
    n_nb = nn.groupBy("_a").agg(F.count(F.lit(1)).alias("_m"))
    draws = df.sparkSession.range(math.ceil(need / n_min)).select(F.col("id").cast("int").alias("_s"))
    cand = n_nb.crossJoin(F.broadcast(draws)).withColumn("_j", F.pmod(F.col("_s"), F.col("_m")).cast("int"))
    cand = cand.join(nn, ["_a", "_j"]).withColumn("_ord", F.xxhash64(F.col("_a"), F.col("_s"), F.lit(seed)))
    ranked = row_positions(cand, ["_s", "_ord", "_a"], "_r").where(F.col("_r") <= need)
    xa = mino.select(F.col(id_col).alias("_a"), *[F.col(f).alias(f"_xa_{f}") for f in features])
    xb = mino.select(F.col(id_col).alias("_b"), *[F.col(f).alias(f"_xb_{f}") for f in features])
    syn = ranked.join(xa, "_a").join(xb, "_b")
    u = (F.pmod(F.xxhash64(F.col("_a"), F.col("_s"), F.lit(seed + 1)), F.lit(1_000_003)) / F.lit(1_000_003.0))
    syn = syn.select(
        (-F.col("_r")).cast(df.schema[id_col].dataType).alias(id_col),
        *[(F.col(f"_xa_{f}") + u * (F.col(f"_xb_{f}") - F.col(f"_xa_{f}"))).alias(f) for f in features],
        F.lit(minority).cast(df.schema[label].dataType).alias(label),
    )
    base = df.select(id_col, *features, label).withColumn("synthetic", F.lit(0))
    return base.unionByName(syn.withColumn("synthetic", F.lit(1)))
