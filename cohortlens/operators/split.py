"""Splits and sampling (M1-M4).

Membership is a pure function of the row's id (a hash bucket), so it is stable
under repartitioning, retries and lost executors -- unlike ``randomSplit``,
whose result depends on the partition layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.sizing import broadcast_if_small
from cohortlens.sources.prepare import row_positions, running_sums


def hash_order(id_col: str, seed: int = 42) -> Column:
    """A deterministic pseudo-random order key of an id."""
    return F.xxhash64(F.col(id_col), F.lit(seed))


def hash_bucket(id_col: str, buckets: int = 100, seed: int = 42) -> Column:
    return F.pmod(hash_order(id_col, seed), F.lit(buckets))


def hash_split(df: DataFrame, id_col: str, test_fraction: float = 0.2, seed: int = 42, bucket: Column | None = None) -> DataFrame:
    """M1: adds ``split`` = 'test' for buckets below ``test_fraction``·100, else 'train'."""
    b = bucket if bucket is not None else hash_bucket(id_col, 100, seed)
    return df.withColumn("split", F.when(b < F.lit(int(round(test_fraction * 100))), "test").otherwise("train"))


def stratified_split(df: DataFrame, label: str, order: Sequence[str], test_fraction: float = 0.2) -> DataFrame:
    """M2: exact per-stratum split: within each label, the first
    ``ceil(test_fraction · n)`` rows in the (pseudo-random, unique) ``order`` are
    test.  Ranks within a stratum come from global positions of a range-sorted
    frame, so a stratum with most of the rows is not sorted in one task."""
    pos = row_positions(df, [label, *order], "_pos")
    # stratum sizes and first positions from their own aggregate (one row per
    # label value) and a running sum, so the sorted frame is consumed once
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    st = running_sums(n, [label], ["_n"], prefix="_before", inclusive=False)
    st = st.select(label, "_n", (F.col("_before_n") + 1).alias("_start"))
    j = pos.join(broadcast_if_small(st), label)  # one row per label value
    rank = F.col("_pos") - F.col("_start")
    n_test = F.ceil(F.col("_n") * F.lit(test_fraction))
    return j.withColumn("split", F.when(rank < n_test, "test").otherwise("train")).drop("_pos", "_start", "_n")


def kfold(df: DataFrame, id_col: str, k: int = 5, seed: int = 42, out: str = "fold", bucket: Column | None = None) -> DataFrame:
    """M3: fold = hash bucket mod k (usable as ``CrossValidator(foldCol=...)``)."""
    b = bucket if bucket is not None else F.pmod(hash_order(id_col, seed), F.lit(k))
    return df.withColumn(out, b.cast("int"))


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42, order: Column | None = None) -> DataFrame:
    """M4: n rows chosen by the smallest hash of the id (the sample is the
    feature; ``limit`` after the order is a top-n, not a full sort)."""
    o = order if order is not None else hash_order(id_col, seed)
    return df.orderBy(o, F.col(id_col)).limit(n)
