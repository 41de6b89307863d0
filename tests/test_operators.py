"""Operator semantics on hand-computed fixtures (FIXTURES.md §3) and invariants."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.operators import clean, encode, features, numeric, profile, report, reshape, stats
from cohortlens.operators.quantiles import order_statistics, quantiles
from cohortlens.sources.prepare import normalise_ids, row_positions, running_sums


def test_parse_metric_name():
    assert reshape.parse_metric_name("Grade_10_Civics_and_Ethics_Test_Score") == (10, "Civics and Ethics", "Test_Score")
    assert reshape.parse_metric_name("Grade_Level") is None
    assert reshape.parse_metric_name("Grade_1_Math_Attendance") == (1, "Math", "Attendance")


def test_parse_name_col_matches_python(spark):
    names = ["Grade_10_Civics_and_Ethics_Test_Score", "Grade_Level", "Grade_1_Math_Attendance"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r) if r[0] is not None else None for r in df.select(reshape.parse_name_col("n").alias("p")).select("p.*").collect()]
    assert got == [reshape.parse_metric_name(n) for n in names]


def test_wide_to_long_filters(spark):
    df = spark.createDataFrame(
        [(1, "50", "-1", "101", "abc", None)],
        "id int, Grade_1_Math_Test_Score string, Grade_2_Math_Test_Score string, Grade_3_Math_Test_Score string, "
        "Grade_4_Math_Test_Score string, Grade_5_Math_Test_Score string",
    )
    kept = reshape.wide_to_long(df, ["id"]).collect()
    assert [(r.Grade_Level, r.Value) for r in kept] == [(1, 50.0)]
    all_range = reshape.wide_to_long(df, ["id"], value_range=None).collect()
    assert sorted(r.Value for r in all_range) == [-1.0, 50.0, 101.0]


def test_stage_mean_default_and_compat(spark):
    df = spark.createDataFrame([(1, 40.0, None, 80.0)], "id int, Grade_1_Math_Test_Score double, Grade_2_Math_Test_Score double, Grade_10_Math_Test_Score double")
    d = features.stage_averages(df).first()
    assert d.Avg_Test_Score_Lower_Primary == pytest.approx(40.0)
    assert d.Avg_Test_Score_Secondary == pytest.approx(80.0)
    c = features.stage_averages(df, compat_prefix=True).first()
    assert c.Avg_Test_Score_Lower_Primary == pytest.approx(60.0)


def test_engagement_weighted(spark):
    df = spark.createDataFrame([(75.0, 65.0, 70.0)], "Overall_Avg_Attendance double, Overall_Avg_Homework double, Overall_Avg_Participation double")
    assert features.engagement_weighted(df).first().Overall_Engagement_Score == pytest.approx(70.5)


def test_age_365_day_years(spark):
    df = spark.createDataFrame([("2005-06-15",), ("2008-02-01",), ("bad",)], "dob string")
    got = [r.Age for r in features.age_parts(df, "dob").collect()]
    assert got == [20.0, 18.0, None]
    served = [r.Age for r in features.age_parts(df, "dob", default_age=17).collect()]
    assert served[-1] == 17.0


TE_ROWS = [(0, "a", 40.0), (1, "a", 60.0), (2, "b", 50.0), (3, "b", 70.0), (4, "b", 90.0), (5, "a", 80.0)]


def test_target_encode_smoothing(spark):
    df = spark.createDataFrame(TE_ROWS, "id long, c string, y double")
    enc = {r.c: r.encoding for r in encode.target_encoder(df, "c", "y").collect()}
    assert enc["a"] == pytest.approx(63.846154, abs=1e-6)
    assert enc["b"] == pytest.approx(66.153846, abs=1e-6)


def test_kfold_target_encode_out_of_fold(spark):
    df = spark.createDataFrame(TE_ROWS, "id long, c string, y double")
    out = encode.kfold_target_encode(df, "c", "y", F.pmod(F.col("id"), F.lit(2)), "te")
    got = [r.te for r in out.orderBy("id").collect()]
    assert got == pytest.approx([65.833333, 62.727273, 65.454545, 65.833333, 65.454545, 62.727273], abs=1e-6)


def test_apply_encoder_unseen_gets_global_mean(spark):
    df = spark.createDataFrame(TE_ROWS, "id long, c string, y double")
    enc = encode.target_encoder(df, "c", "y")
    new = spark.createDataFrame([(9, "zzz")], "id long, c string")
    assert encode.apply_encoder(new, enc, "c", "e").first().e == pytest.approx(65.0)


def test_one_hot_drop_first(spark):
    df = spark.createDataFrame([("Public",), ("Private",), ("NGO-operated",)], "t string")
    out = encode.one_hot(df, ["t"])
    assert sorted(out.columns) == ["t_Private", "t_Public"]


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.normal(size=2000).round(3)
    grp = rng.integers(0, 3, size=2000)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(grp, vals)], "g int, v double")
    q = {r.g: r for r in quantiles(df, "v", [0.1, 0.25, 0.5, 0.9], ["g"]).collect()}
    for g in range(3):
        exp = np.quantile(vals[grp == g], [0.1, 0.25, 0.5, 0.9])
        assert [q[g].q10, q[g].q25, q[g].q50, q[g].q90] == pytest.approx(exp.tolist(), abs=1e-9)
    glob = quantiles(df, "v", [0.25]).first()[0]
    assert glob == pytest.approx(float(np.quantile(vals, 0.25)), abs=1e-9)


def test_quantile_small_fixture(spark):
    df = spark.createDataFrame([(10.0,), (5.0,), (7.0,)], "x double")
    assert quantiles(df, "x", [0.25]).first()[0] == pytest.approx(6.0)


def test_order_statistics(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 4, 2, 3]], "x double")
    r = order_statistics(df, "x", {"lo": F.lit(0), "hi": F.col("_n") - 1, "mid": F.floor(F.col("_n") / 2)}).first()
    assert (r.lo, r.hi, r.mid) == (1.0, 5.0, 3.0)


def test_row_positions_equal_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id"))
    p = row_positions(df, ["k", "id"], "pos")
    r = df.withColumn("rn", F.row_number().over(Window.orderBy("k", "id")))
    assert p.join(r, ["k", "id"]).where("pos != rn").count() == 0
    assert p.count() == 5000


def test_running_sums(spark):
    df = spark.createDataFrame([(float(i), i % 3) for i in range(100)], "s double, v int")
    out = running_sums(df, [F.desc("s")], ["v"]).orderBy(F.desc("s")).collect()
    exp = np.cumsum([i % 3 for i in range(99, -1, -1)])
    assert [r.cum_v for r in out] == exp.tolist()


def test_normalise_ids_positional_fill(spark):
    df = spark.createDataFrame([("7", 1), ("x", 2), (None, 3)], "sid string, o int")
    got = [r.sid for r in normalise_ids(df, "sid", ["o"]).orderBy("o").collect()]
    assert got == [7, 2, 3]


def test_iqr_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    r = profile.iqr_outliers(df, ["x"]).first()
    assert (r.q1, r.q3, r.n_outliers) == (2.0, 4.0, 1)


def test_describe(spark):
    df = spark.createDataFrame([(10.0,), (5.0,), (7.0,)], "x double")
    r = profile.describe(df, ["x"]).first()
    assert r.q25 == pytest.approx(6.0) and r.std == pytest.approx(2.516611, abs=1e-6) and r["count"] == 3


def test_histogram_numpy_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 10, 20, 30, 100]], "x double")
    h = {r.bin: r.n for r in profile.histogram(df, "x", 5).collect()}
    assert [h.get(i, 0) for i in range(5)] == [2, 2, 0, 0, 1]


def test_trend_line(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 5.0), (4.0, 8.0)], "x double, y double")
    r = stats.trend_line(df, "x", "y").first()
    assert r.slope == pytest.approx(1.9) and r.intercept == pytest.approx(0.0, abs=1e-9) and r.r2 == pytest.approx(0.962667, abs=1e-6)


def test_durbin_watson(spark):
    df = spark.createDataFrame([(i, float(e)) for i, e in enumerate([1, -1, 2, 0, -2])], "t int, e double")
    assert stats.durbin_watson(df, "e", ["t"]).first().durbin_watson == pytest.approx(2.1)


def test_auc_with_tie(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 1], [0.1, 0.5, 0.5, 0.8, 0.4])), "y int, s double")
    assert stats.roc_auc(df, "y", "s").first().auc == pytest.approx(0.75)


def test_fallback_score(spark):
    df = spark.createDataFrame(
        [(0.5, 0.5, 40.0, 75.0, 65.0, 70.0)], "res double, tb double, ratio double, att double, hw double, part double"
    )
    roles = {"resources": "res", "textbook": "tb", "ratio": "ratio", "attendance": "att", "homework": "hw", "participation": "part"}
    score, risk = numeric.fallback_score(roles)
    short, _ = numeric.fallback_score(roles, short=True)
    r = df.select(score.alias("s"), risk.alias("r"), short.alias("t")).first()
    assert r.s == pytest.approx(60.8504, abs=1e-4) and r.r == pytest.approx(0.164165, abs=1e-6) and r.t == pytest.approx(58.8336, abs=1e-4)


def test_dedupe_first(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 5)], "k int, v string, o int")
    got = sorted((r.k, r.v) for r in clean.dedupe_first(df, ["k"], ["o"]).collect())
    assert got == [(1, "a"), (2, "c")]


def test_null_group_key_excluded(spark):
    df = spark.createDataFrame([("X", 1, 10.0), (None, 2, 20.0)], "Region string, id int, v double")
    out = report.grouping_summaries(df, ["Region"], "id", "v").collect()
    assert [(r.member, r.n) for r in out] == [("X", 1)]


def test_pass_rate_null_in_denominator(spark):
    df = spark.createDataFrame([(40.0,), (60.0,), (None,)], "x double")
    assert report.kpi_overview(df, "x").first().pass_rate == pytest.approx(100 / 3)


def test_id_search_escapes_wildcards(spark):
    df = spark.createDataFrame([("a_1",), ("ab1",)], "id string")
    assert [r.id for r in clean.id_search(df, "id", "_1").collect()] == ["a_1"]


def test_winsorize_uses_train_limits(spark):
    train = spark.createDataFrame([(float(v),) for v in range(1000)], "x double")
    lim = numeric.winsor_limits(train, "x")
    r = lim.first()
    assert (r.lo, r.hi) == (5.0, 994.0)
    test = spark.createDataFrame([(-50.0,), (5000.0,)], "x double")
    assert [x.x for x in numeric.winsorize(test, "x", lim).collect()] == [5.0, 994.0]


def _yj(x, lam):
    out = np.empty_like(x)
    pos = x >= 0
    out[pos] = np.log1p(x[pos]) if abs(lam) < 1e-12 else ((x[pos] + 1) ** lam - 1) / lam
    out[~pos] = -np.log1p(-x[~pos]) if abs(2 - lam) < 1e-12 else -((1 - x[~pos]) ** (2 - lam) - 1) / (2 - lam)
    return out


def test_yeo_johnson_fit_is_the_grid_mle(spark):
    """The one-pass grid fit picks the λ maximising the Yeo-Johnson
    log-likelihood, checked against a direct numpy evaluation of it."""
    rng = np.random.default_rng(0)
    x = rng.lognormal(0, 0.6, 3000) - 0.5
    grid = np.round(np.arange(-2.0, 2.0001, 0.05), 4)
    n = len(x)
    s = np.sum(np.sign(x) * np.log1p(np.abs(x)))
    ll = [-n / 2 * np.log(np.var(_yj(x, lam))) + (lam - 1) * s for lam in grid]
    expected = float(grid[int(np.argmax(ll))])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = numeric.yeo_johnson_fit(df, "x", grid=list(grid)).first()[0]
    assert got == pytest.approx(expected)
    out = numeric.yeo_johnson(df, "x", 0.5).select("x").toPandas()["x"].to_numpy()
    assert out == pytest.approx(_yj(x, 0.5), rel=1e-9)
