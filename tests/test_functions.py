"""Micro-fixtures of FIXTURES.md §3 for the Column helpers."""

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import categorize as cat
from cohortlens.functions.mathx import logistic, sample_skewness
from cohortlens.functions.rowwise import row_mean, row_std, row_sum


def test_tier_bins_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 50.0, 50.1, 70.0, 85.0, 100.0, 101.0, None]], "x double")
    got = [r[0] for r in df.select(cat.tier_bin("x")).collect()]
    assert got == [None, "Critical", "Needs Improvement", "Needs Improvement", "Satisfactory", "Excellent", None, None]


def test_level_bands(spark):
    df = spark.createDataFrame([(v,) for v in [49.9, 50.0, 69.9, 70.0, None]], "x double")
    assert [r[0] for r in df.select(cat.level_band("x")).collect()] == ["Low", "Medium", "Medium", "High", None]


def test_yes_no_decode(spark):
    df = spark.createDataFrame([(v,) for v in ["Yes", "y", "TRUE", "1", "No", None, "other"]], "x string")
    assert [r[0] for r in df.select(cat.yes_no_decode("x")).collect()] == [1, 1, 1, 1, 0, 0, 0]


def test_parental_decode(spark):
    df = spark.createDataFrame([(v,) for v in ["0.32", "0.33", "0.66", "x", None]], "x string")
    assert [r[0] for r in df.select(cat.parental_decode("x")).collect()] == ["Low", "Medium", "High", "Unknown", "Unknown"]


def test_subject_category(spark):
    df = spark.createDataFrame([(v,) for v in ["Math", "History", "Afan Oromoo", "Art", "ICT"]], "s string")
    assert [r[0] for r in df.select(cat.subject_category("s")).collect()] == ["STEM", "Humanities", "Language", "Other", "STEM"]


def test_lookup_default(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    assert [r[0] for r in df.select(cat.lookup("k", {"a": 1}, 7)).collect()] == [1, 7, 7]


def test_row_mean_skips_nulls_and_all_null(spark):
    df = spark.createDataFrame([(40.0, None, 80.0), (None, None, None)], "a double, b double, c double")
    got = df.select(row_mean(["a", "b", "c"]).alias("m"), row_sum(["a", "b", "c"]).alias("s")).collect()
    assert got[0]["m"] == pytest.approx(60.0) and got[1]["m"] is None
    assert got[1]["s"] == 0.0


def test_row_mean_many_columns_no_stack_overflow(spark):
    cols = [f"c{i}" for i in range(600)]
    df = spark.range(3).select(*[(F.col("id") + i).cast("double").alias(c) for i, c in enumerate(cols)])
    got = df.select(row_mean(cols).alias("m")).collect()
    assert [r["m"] for r in got] == pytest.approx([299.5, 300.5, 301.5])


def test_row_std_sample(spark):
    df = spark.createDataFrame([(10.0, 5.0, 7.0)], "a double, b double, c double")
    assert df.select(row_std(["a", "b", "c"])).first()[0] == pytest.approx(2.516611, abs=1e-6)


def test_sample_skewness_matches_pandas(spark):
    df = spark.createDataFrame([(10.0,), (5.0,), (7.0,)], "x double")
    # pandas Series([10, 5, 7]).skew() = 0.5855827 (FIXTURES.md rounds it as 0.585573)
    assert df.agg(sample_skewness("x")).first()[0] == pytest.approx(0.5855827, abs=1e-6)


def test_logistic(spark):
    assert spark.range(1).select(logistic(F.lit(60.8504))).first()[0] == pytest.approx(0.164165, abs=1e-6)


def test_title_case(spark):
    df = spark.createDataFrame([(" dental problems ",)], "x string")
    assert df.select(cat.title_case("x")).first()[0] == "Dental Problems"
