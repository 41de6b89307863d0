"""Exact quantiles and order statistics against numpy; ties, groups, narrowing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import quantiles as q
from cohortlens.operators import sizing
from cohortlens.sources.prepare import ranged, row_positions

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
NAMES = [f"p{i}" for i in range(len(PROBS))]


def _values(kind, n, rng):
    if kind == "ties":  # a third of the rows is one value
        return np.where(rng.random(n) < 1 / 3, 7.5, rng.normal(size=n))
    if kind == "wide":
        return np.exp(rng.normal(0, 100, n)) * rng.choice([-1.0, 1.0], n)
    if kind == "few":
        return rng.integers(0, 4, n).astype(float)
    return rng.normal(size=n)


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "few"])
@pytest.mark.parametrize("kept", [100_000, 60])
def test_against_numpy(spark, monkeypatch, kind, kept):
    monkeypatch.setattr(q, "KEPT_VALUES", kept)  # 60: narrowed again and again
    rng = np.random.default_rng(11)
    sizes = {"a": 20_000, "b": 700, "c": 5, "d": 1, "e": 2}
    data = {g: _values(kind, n, rng) for g, n in sizes.items()}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None), ("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: [r[n] for n in NAMES] for r in q.quantiles(df, "v", PROBS, ["g"], NAMES).collect()}
    assert set(got) == set(sizes)
    for g, vs in data.items():
        np.testing.assert_allclose(got[g], np.quantile(vs, PROBS), rtol=1e-12)
    whole = np.concatenate([*data.values(), [1.0]])
    one = q.quantiles(df, "v", PROBS, names=NAMES).first()
    np.testing.assert_allclose([one[n] for n in NAMES], np.quantile(whole, PROBS), rtol=1e-12)


def test_order_statistics_in_any_order(spark):
    v = np.random.default_rng(2).permutation(5000).astype(float)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = q.order_statistics(df, "v", {"last": F.col("_n") - 1, "third": F.lit(2), "mid": F.floor(F.col("_n") / 2)}).first()
    assert (got["last"], got["third"], got["mid"]) == (4999.0, 2.0, 2500.0)


def test_brackets_that_miss_are_widened(spark, monkeypatch):
    real = q._sketch

    def wrong(*args):
        d, s = real(*args)
        return d, s.withColumn("_grid", F.transform("_grid", lambda x: x + 3))

    monkeypatch.setattr(q, "_sketch", wrong)
    v = np.random.default_rng(5).random(4000)
    got = q.quantiles(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", [0.3], names=["m"]).first()["m"]
    assert got == pytest.approx(np.quantile(v, 0.3), rel=1e-12)


def test_extra_aggregates_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "g string, v double")
    got = q.quantiles(df, "v", [0.5], ["g"], ["m"], extra={"s": F.sum("_v")}).collect()
    assert [tuple(r) for r in got] == [("a", 2.0, 4.0)]
    assert [tuple(r) for r in q.quantiles(df.where("v > 9"), "v", [0.5], names=["m"]).collect()] == [(None,)]
    assert q.quantiles(df.where("v > 9"), "v", [0.5], ["g"]).count() == 0


def test_no_sort_of_the_values(spark):
    """Only the small table of counts is put in order."""
    seen = []
    real = q.materialize
    try:
        q.materialize = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df)
        q.quantiles(spark.range(50_000).select((F.col("id") % 977).cast("double").alias("v")), "v", [0.5])
    finally:
        q.materialize = real
    assert len(seen) == 3 and not any("rangepartitioning" in p for p in seen)


def test_ranges_of_a_heavy_tie_are_even(spark):
    n, parts = 600_000, 32
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        key = F.when(F.col("id") % 3 == 0, F.lit(250_000)).otherwise(F.col("id"))
        df = spark.range(0, n, 1, 8).select(key.alias("k"), F.col("id").alias("payload"))
        sizes = [r["count"] for r in ranged(df, ["k"]).groupBy("_range").count().collect()]
        assert sum(sizes) == n and max(sizes) <= 2 * n / parts
        same = spark.range(0, n, 1, 8).select(F.lit(1).alias("k"))  # equal altogether
        assert max(r["count"] for r in ranged(same, ["k"]).groupBy("_range").count().collect()) <= 2 * n / parts
        pos = row_positions(df, ["k"], "p")
        w = pos.agg(F.countDistinct("p"), F.min("p"), F.max("p")).first()
        assert tuple(w) == (n, 1, n)
        low = pos.groupBy((F.col("k") < 250_000).alias("low")).agg(F.max("p").alias("hi"), F.min("p").alias("lo"))
        b = {r["low"]: r for r in low.collect()}
        assert b[True]["hi"] < b[False]["lo"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_few_groups_never_deal_the_rows_by_group(spark, monkeypatch):
    """The optimizer takes an aggregate to be as large as its input: the brackets of a
    large input were joined by a shuffle that put all rows of a group into one task."""
    monkeypatch.setattr(sizing, "estimated_bytes", lambda df: 1 << 40)
    plans, stored = [], q.materialize

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    monkeypatch.setattr(q, "materialize", seen)
    rows = spark.range(3000).select(F.pmod("id", F.lit(3)).alias("g"), F.col("id").cast("double").alias("v"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = q.quantiles(rows, "v", [0.5], ["g"], ["m"])
        assert {r["g"]: r["m"] for r in got.collect()} == {0: 1498.5, 1: 1499.5, 2: 1500.5}
        assert "BroadcastHashJoin" in plans[1] and "SortMergeJoin" not in plans[1]  # the counts
        monkeypatch.setattr(q, "SMALL_GROUPS", 2)
        more = q.quantiles(rows, "v", [0.5], ["g"], ["m"])  # many groups: a shuffle, the same rows
        assert sorted(map(tuple, more.collect())) == sorted(map(tuple, got.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
