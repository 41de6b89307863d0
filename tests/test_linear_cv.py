"""Gram-matrix cross-validation against Spark ML's fits of every fold."""

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from cohortlens.operators import models
from cohortlens.operators.linear_cv import fold_grams, linear_cv, solve

FEATURES = ["a", "b", "c", "d"]


def _frame(spark, n=600, gaps=False):
    rng = np.random.default_rng(8)
    x = rng.normal([50, 0, 1e4, 3], [10, 1, 500, 0.01], (n, 4))
    y = 2 * x[:, 0] - 5 * x[:, 1] + 0.01 * x[:, 2] + rng.normal(0, 4, n)
    rows = [[*map(float, r), float(t), i % 5] for i, (r, t) in enumerate(zip(x, y))]
    if gaps:
        for i in range(0, n, 7):
            rows[i][i % 4] = None if i % 2 else float("nan")
        rows += [[1.0, 2.0, 3.0, 4.0, None, 1], [1.0, 2.0, 3.0, 4.0, 5.0, None]]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y double, fold int").repartition(3)


@pytest.mark.parametrize("mix", [0.0, 1.0, 0.4])
def test_equals_spark_ml(spark, mix):
    df, grid = _frame(spark), [0.0, 0.05, 1.0, 7.0]
    got = {r["reg"]: r for r in linear_cv(df, FEATURES, "y", "fold", {"m": (mix, grid)}).collect()}
    est = LinearRegression(elasticNetParam=mix, tol=1e-12, maxIter=5000)
    want = models.cross_validate(df, FEATURES, "y", est, {"regParam": grid}, "fold").collect()
    for w in want:
        reg = float(w["params"].split("=")[1])
        assert got[reg]["mean_r2"] == pytest.approx(w["mean_r2"], abs=1e-6)
        assert got[reg]["std_r2"] == pytest.approx(w["std_r2"], abs=1e-6)


def test_gaps_are_filled_with_the_training_median(spark):
    df = _frame(spark, gaps=True)
    got = linear_cv(df, FEATURES, "y", "fold", {"ridge": (0.0, [0.5])}).first()
    rows = [r for r in df.collect() if r["y"] is not None and r["fold"] is not None]
    x = np.array([[np.nan if r[c] is None else r[c] for c in FEATURES] for r in rows])
    y, fold = np.array([r["y"] for r in rows]), np.array([r["fold"] for r in rows])
    scores = []
    for f in range(5):
        train = fold != f
        z = np.where(np.isnan(x), np.nanquantile(x[train], 0.5, axis=0, method="inverted_cdf"), x)
        m, s = z[train].mean(0), z[train].std(0)
        u, t = (z[train] - m) / s, y[train]
        w = np.linalg.solve(u.T @ u / len(u) + 0.5 / t.std() * np.eye(4), u.T @ (t - t.mean()) / len(u))
        error = y[~train] - t.mean() - (z[~train] - m) / s @ w
        scores.append(1 - (error**2).sum() / ((y[~train] - y[~train].mean()) ** 2).sum())
    assert (got["mean_r2"], got["std_r2"]) == pytest.approx((np.mean(scores), np.std(scores)), abs=1e-9)


def test_a_single_pass_over_the_rows(spark, monkeypatch):
    scans = []
    real = type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, *a, **b: scans.append(1) or real(self, *a, **b))
    linear_cv(_frame(spark), FEATURES, "y", "fold", {"l": (1.0, [0.1, 1.0]), "r": (0.0, [0.1, 1.0])})
    assert len(scans) == 1


def test_constant_and_dependent_features(spark):
    df = _frame(spark, 100).withColumns({"k": F.lit(3.0), "a2": F.col("a") * 2})
    for mix in (0.0, 1.0):
        got = linear_cv(df, [*FEATURES, "k", "a2"], "y", "fold", {"m": (mix, [0.0, 0.1])}).collect()
        assert all(r["mean_r2"] > 0.8 for r in got)


def test_one_fold_is_refused(spark):
    with pytest.raises(ValueError):
        linear_cv(_frame(spark).withColumn("fold", F.lit(1)), FEATURES, "y", "fold", {"m": (0.0, [0.0])})


def test_large_offsets(spark):
    """Sums are taken around the means, so a far origin costs no digits."""
    far = _frame(spark).withColumns({c: F.col(c) + 1e7 for c in FEATURES})
    near = linear_cv(_frame(spark), FEATURES, "y", "fold", {"m": (0.0, [0.5])}).first()["mean_r2"]
    assert linear_cv(far, FEATURES, "y", "fold", {"m": (0.0, [0.5])}).first()["mean_r2"] == pytest.approx(near, abs=1e-7)
    assert solve(sum(fold_grams(_frame(spark), FEATURES, "y", "fold", np.zeros(5)).values())[np.ix_([0, 8, 9], [0, 8, 9])], 0.0, 0.0)[0].shape == (2,)
