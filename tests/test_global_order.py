"""Global positions and running sums on data with payload columns: complete,
unique and independent of adaptive execution and of the number of partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators.stats import durbin_watson, roc_auc
from cohortlens.sources.prepare import normalise_ids, row_positions, running_sums

N = 600_000


@pytest.fixture(params=[(True, 8), (False, 8), (True, 50), (False, 200)])
def wide(request, spark):
    aqe, parts = request.param
    keys = {"spark.sql.adaptive.enabled": str(aqe).lower(), "spark.sql.shuffle.partitions": str(parts)}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    x = F.pmod(F.col("id") * 7919, F.lit(N))
    yield spark.range(0, N, 1, 12).select(x.alias("k"), F.concat(F.lit("payload "), F.repeat(x.cast("string"), 3)).alias("t"), F.sin(x * 1.0).alias("e"))
    for k, v in before.items():
        spark.conf.set(k, v)


def test_positions(wide):
    pos = row_positions(wide, ["k"], "p")
    r = pos.agg(F.count("*"), F.countDistinct("p"), F.min("p"), F.max("p"), F.count_if(F.col("p") != F.col("k") + 1)).first()
    assert tuple(r) == (N, N, 1, N, 0) and set(pos.columns) == {"k", "t", "e", "p"}


def test_running_sums(wide):
    r = running_sums(wide, [F.desc("k")], ["k"]).agg(F.count("*"), F.max("cum_k"), F.count_if(F.col("k") == N - 1)).first()
    assert tuple(r) == (N, N * (N - 1) // 2, 1)
    above = running_sums(wide, ["k"], ["k"], inclusive=False)
    assert above.where(F.col("cum_k") != F.col("k") * (F.col("k") - 1) / 2).count() == 0


def test_durbin_watson(wide):
    e = np.sin(np.arange(N, dtype=float))
    r = durbin_watson(wide, "e", ["k"]).first()
    assert r["n"] == N and r["durbin_watson"] == pytest.approx(((e[1:] - e[:-1]) ** 2).sum() / (e**2).sum(), rel=1e-9)


def test_positional_ids(wide):
    ids = normalise_ids(wide.withColumn("id", F.when(F.col("k") % 3 == 0, F.col("k").cast("string")).otherwise("x")), "id", ["k"])
    assert ids.where(F.col("id") != F.when(F.col("k") % 3 == 0, F.col("k")).otherwise(F.col("k") + 1)).count() == 0 and ids.count() == N


def test_auc_of_distinct_scores(wide):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    d = wide.select((F.col("k") / N).alias("s"), (F.pmod(F.xxhash64("k"), F.lit(1000)) < F.col("k") * 1000 / N).cast("int").alias("y"))
    want = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0).evaluate(d)
    assert roc_auc(d, "y", "s").first()["auc"] == pytest.approx(want, abs=1e-9)


def test_empty(spark):
    d = spark.createDataFrame([], "k bigint, e double")
    assert row_positions(d, ["k"]).count() == 0 and running_sums(d, ["k"], ["e"]).count() == 0
    assert durbin_watson(d, "e", ["k"]).first()["n"] == 0
