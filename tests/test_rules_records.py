"""Rule table, local attribution, model records, the closing table."""

import json

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from cohortlens.operators import model_record as mr
from cohortlens.operators import models, report, rules
from cohortlens.operators.attribution import fit_linear, local_attribution

ROLES = {"resources": "res", "attendance": "att", "homework": "hw", "health": "health", "internet": "net"}


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        pick = lambda *v: v[rng.integers(len(v))]
        rows.append((i, pick(None, 0.1, 0.4, 0.9), pick(None, 50.0, 80.0, 95.0), pick(None, 20.0, 99.0), pick(None, "Severe", "No Issue"), pick("Yes", "No", None), float(rng.random())))
    return spark.createDataFrame(rows, "id int, res double, att double, hw double, health string, net string, p double")


def test_detailed_set_equals_the_expressions(spark, people):
    score, risk = F.lit(61.25) + F.col("id"), F.col("p")
    got = rules.evaluate_rules(people, rules.rule_table(spark), "detailed", ROLES, score, risk)
    want = people.withColumn("messages", rules.recommendations(ROLES, score, risk))
    assert got.orderBy("id").collect() == want.orderBy("id").collect() and got.columns == want.columns


def test_brief_set(spark, people):
    got = rules.evaluate_rules(people, rules.rule_table(spark), "brief", ROLES, F.lit(61.0), F.col("p"))
    texts = {r["id"]: r["messages"] for r in got.collect()}
    factors = {r["id"]: r["f"] for r in people.select("id", rules.risk_factors(ROLES).alias("f")).collect()}
    for r in people.collect():
        if r["p"] > 0.5:
            assert texts[r["id"]][:4] == rules.BRIEF_AT_RISK
            assert ("Arrange health support services" in texts[r["id"]]) == (r["health"] == "Severe")
            assert ("Provide internet access support" in texts[r["id"]]) == (r["net"] != "Yes")
        else:
            assert texts[r["id"]][1:3] == ["Predicted Overall Average: 61.0", f"Risk Probability: {round(r['p'] * 100, 1)}% (Low)"]
            assert texts[r["id"]][5:] == ["Areas for continued improvement:", *[f"Address {f.lower()}" for f in factors[r["id"]]]]


def test_rules_are_data(spark, people):
    table = spark.createDataFrame([("own", 1, None, None, "attendance", "ge", 90.0, None, "Well attended")], rules.RULE)
    got = rules.evaluate_rules(people, table, "own", ROLES, F.lit(0.0), F.lit(0.0)).where(F.size("messages") > 0)
    assert got.count() == people.where("att >= 90").count() > 0
    assert rules.evaluate_rules(people, table, "no such set", ROLES, F.lit(0.0), F.lit(0.0)).where(F.size("messages") > 0).count() == 0


def _numbers(spark, n=300):
    rng = np.random.default_rng(4)
    x = rng.normal([5, -100, 0.1], [2, 30, 0.05], (n, 3))
    y = 3 * x[:, 0] - 0.2 * x[:, 1] + rng.normal(0, 1, n)
    return spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, a double, b double, c double, y double"), x, y


def test_contributions_add_up(spark):
    df, x, y = _numbers(spark)
    fit = fit_linear(df, ["a", "b", "c"], "y")
    w, *_ = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)
    np.testing.assert_allclose([*fit.coefficients, fit.intercept], w, rtol=1e-8)
    got = local_attribution(df, fit, ["id"]).collect()
    for i in range(0, 300, 37):
        mine = sorted((r for r in got if r["id"] == i), key=lambda r: r["rank"])
        assert sum(r["contribution"] for r in mine) + fit.base == pytest.approx(np.append(x[i], 1) @ w)
        sizes = [abs(r["contribution"]) for r in mine]
        assert sizes == sorted(sizes, reverse=True) and sum(r["share"] for r in mine) == pytest.approx(1)
    top = local_attribution(df, fit, ["id"], top=1)
    assert top.count() == 300 and "Exchange" not in top._jdf.queryExecution().executedPlan().toString()


def test_missing_values_contribute_nothing(spark):
    df, *_ = _numbers(spark)
    fit = fit_linear(df, ["a", "b"], "y")
    empty = spark.createDataFrame([(1, None, None)], "id int, a double, b double")
    assert [(r["contribution"], r["share"]) for r in local_attribution(empty, fit, ["id"]).collect()] == [(0.0, None)] * 2
    with pytest.raises(ValueError):
        fit_linear(df.where("a > 1e9"), ["a"], "y")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    df, *_ = _numbers(spark)
    path = str(tmp_path_factory.mktemp("models") / "m")
    model = models.assemble_model(["a", "b"], LinearRegression(labelCol="y", featuresCol="features")).fit(df)
    record = mr.save_model(model, path, "linear", ["a", "b"], "y", df, threshold=0.5)
    return df, path, model, record


def test_record_round_trip(spark, stored):
    df, path, model, record = stored
    assert mr.read_record(spark, path) == record
    assert record["feature_order"] == ["a", "b"] and set(record["medians"]) == {"a", "b"} and record["threshold"] == 0.5
    assert record["medians"]["b"] == pytest.approx(-100, abs=10)
    again, _ = mr.load_model(path, df, "y", ["a", "b"])
    assert models.compare_predictions(model, again, df, "id").first()["identical"]
    assert mr.predict(path, df.drop("y")).count() == 300


@pytest.mark.parametrize(
    "change, asked, message",
    [
        (lambda d: d.drop("a"), {}, "features missing: \\['a'\\]"),
        (lambda d: d.withColumn("b", F.col("b").cast("string")), {}, "no longer numeric: \\['b'\\]"),
        (lambda d: d, {"target": "z"}, "trained for 'y', not 'z'"),
        (lambda d: d, {"features": ["b", "a"]}, "feature order"),
    ],
)
def test_mismatches_are_refused(stored, change, asked, message):
    df, path, *_ = stored
    with pytest.raises(mr.RecordMismatch, match=message):
        mr.load_model(path, change(df), **asked)


def test_other_versions_are_refused(spark, stored, tmp_path):
    record = dict(stored[3], version="v0")
    spark.createDataFrame([(json.dumps(record),)], "value string").write.text(str(tmp_path / "m" / "record"))
    with pytest.raises(mr.RecordMismatch, match="v0"):
        mr.read_record(spark, str(tmp_path / "m"))


def test_closing_table(spark):
    scores = spark.createDataFrame([(40.0,), (60.0,), (None,)], "v double")
    clusters = spark.createDataFrame([("High", 1), ("Low", 3)], "label string, n bigint")
    fits = spark.createDataFrame([("b", 0.5, 2.0), ("a", 0.5, 1.0), ("c", 0.1, 0.5)], "model string, r2 double, mae double")
    classes = spark.createDataFrame([], "model string, f1 double, auc double")
    risks = spark.createDataFrame([("x", 10.0), ("y", 30.0), (None, 99.0)], "g string, pct_label double")
    got = {(r["section"], r["metric"]): (r["value"], r["share"], r["name"]) for r in report.summary_table(scores, "v", 50, clusters, fits, classes, risks, "g").collect()}
    assert got["dataset", "rows"] == (3.0, 100.0, None) and got["dataset", "at_risk"] == (1.0, pytest.approx(100 / 3), None)
    assert got["clusters", "low"] == (3.0, 75.0, None) and got["clusters", "medium"] == (0.0, 0.0, None)
    assert got["models", "best_mae"] == (1.0, None, "a")
    assert got["classifiers", "best_f1"] == (None, None, None)
    assert got["risk", "highest"] == (30.0, None, "y") and got["risk", "lowest"] == (10.0, None, "x")
