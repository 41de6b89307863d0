"""Yeo-Johnson search, kernel density curves, hashed cardinality."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import numeric, profile


def _yj(x, lam):
    pos = np.log1p(np.maximum(x, 0)) if abs(lam) < 1e-12 else ((np.maximum(x, 0) + 1) ** lam - 1) / lam
    neg = -np.log1p(np.maximum(-x, 0)) if abs(2 - lam) < 1e-12 else -((np.maximum(-x, 0) + 1) ** (2 - lam) - 1) / (2 - lam)
    return np.where(x >= 0, pos, neg)


def _likelihood(x, lam):
    return -len(x) / 2 * np.log(_yj(x, lam).var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()


def _golden(x, a, b):
    g = (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    while b - a > 1e-9:
        if _likelihood(x, c) > _likelihood(x, d):
            b, d = d, c
            c = b - g * (b - a)
        else:
            a, c = c, d
            d = a + g * (b - a)
    return (a + b) / 2


@pytest.mark.parametrize("kind", ["lognormal", "mixed", "far"])
def test_lambda_of_a_scalar_search(spark, kind):
    rng = np.random.default_rng(1)
    x = {"lognormal": np.exp(rng.normal(0, 1, 3000)), "mixed": rng.normal(0.3, 2, 3000), "far": 5 - np.exp(rng.normal(-2, 0.3, 3000))}[kind]
    got = numeric.yeo_johnson_fit(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double"), "x").first()
    want = _golden(x, -60, 60)
    assert got["lambda"] == pytest.approx(want, abs=1e-4) and not got["at_edge"]
    assert got["log_likelihood"] == pytest.approx(_likelihood(x, want), rel=1e-9)
    if kind == "far":
        assert want > 3  # beyond the range searched first


def test_grid_edges_are_flagged(spark):
    x = spark.createDataFrame([(float(v),) for v in 5 - np.exp(np.random.default_rng(1).normal(-2, 0.3, 500))], "x double")
    got = numeric.yeo_johnson_fit(x, "x", [-1.0, 0.0, 1.0]).first()
    assert got["lambda"] == 1.0 and got["at_edge"]


def test_lambda_without_values(spark):
    for rows in ([], [(None,)], [(4.0,), (4.0,)]):
        got = numeric.yeo_johnson_fit(spark.createDataFrame(rows, "x double"), "x").first()
        assert (got["lambda"], got["log_likelihood"], got["at_edge"]) == (1.0, None, False)


def test_density_curve(spark):
    rng = np.random.default_rng(7)
    data = {"a": rng.normal(50, 8, 4000), "b": np.concatenate([rng.normal(0, 1, 500), rng.normal(9, 0.5, 500)])}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("c", 1.0), ("c", 1.0), ("d", None), (None, 3.0), ("a", float("nan"))]
    got = profile.density_curve(spark.createDataFrame(rows, "g string, v double"), "v", "g").orderBy("g", "point").collect()
    assert {r["g"] for r in got} == set(data)
    for g, v in data.items():
        x, y = (np.array([r[c] for r in got if r["g"] == g]) for c in ("x", "density"))
        bw = v.std(ddof=1) * len(v) ** -0.2
        assert len(x) == 200 and x[0] == pytest.approx(v.min() - 3 * bw) and x[-1] == pytest.approx(v.max() + 3 * bw)
        assert np.trapezoid(y, x) == pytest.approx(1, abs=2e-3)
        exact = np.exp(-(((x[:, None] - v) / bw) ** 2) / 2).sum(1) / (len(v) * bw * math.sqrt(2 * math.pi))
        np.testing.assert_allclose(y, exact, atol=1e-4 * exact.max())


def test_cardinality_moves_no_text(spark):
    df = spark.range(3000).select(F.concat(F.lit("id-"), "id").alias("k"), (F.col("id") % 7).alias("m"), F.when(F.col("id") > 2, F.lit("x")).alias("n"))
    got = {r["column"]: (r["n_unique_with_null"], r["n_unique"]) for r in profile.cardinality(df, df.columns).collect()}
    assert got == {"k": (3000, 3000), "m": (7, 7), "n": (2, 1)}


def test_cardinality_of_equal_hashes(spark, monkeypatch):
    """Values forced onto few hashes are told apart by their texts."""
    real = F.xxhash64
    monkeypatch.setattr(profile.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(1000)) if len(c) > 1 else F.pmod(real(*c), F.lit(5)))
    df = spark.range(400).select(F.concat(F.lit("id-"), F.col("id") % 90).alias("k"), F.lit(None).cast("int").alias("z"))
    got = {r["column"]: (r["n_unique_with_null"], r["n_unique"]) for r in profile.cardinality(df, df.columns).collect()}
    assert got == {"k": (90, 90), "z": (1, 0)}
