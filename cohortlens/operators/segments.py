"""Segment tables: shares within a group, share pivots, rank labels, risk by group
(W1, R7, W2, L12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.sizing import broadcast_if_small


def share_within(df: DataFrame, group: str, member: str) -> DataFrame:
    """``(group, member, n, share)`` with share = n / Σn of the group.  The
    window runs over the aggregated (group × member) table, not the rows."""
    d = df.where(F.col(group).isNotNull() & F.col(member).isNotNull())
    c = d.groupBy(group, member).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def share_pivot(df: DataFrame, group: str, member: str, members: Sequence) -> DataFrame:
    """The shares unstacked, one column per member (explicit member list:
    no extra distinct pass); absent members are 0."""
    s = share_within(df, group, member)
    p = s.groupBy(group).pivot(member, list(members)).agg(F.first("share"))
    return p.fillna(0.0, subset=[str(m) for m in members])


def rank_labels(df: DataFrame, cluster: str, value: str, labels: Sequence[str] = ("High", "Medium", "Low")) -> DataFrame:
    """Clusters ranked by mean value (descending) and named by rank; the
    window runs on the k-row cluster table."""
    m = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"))
    r = m.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_value"), cluster)))
    name = None
    for i, lab in enumerate(labels, start=1):
        name = F.when(F.col("rank") == i, F.lit(lab)) if name is None else name.when(F.col("rank") == i, F.lit(lab))
    return r.withColumn("label", name)


def label_rows(df: DataFrame, ranked: DataFrame, cluster: str, out: str = "cluster_label") -> DataFrame:
    """Attach the cluster label to every row (the ranked table has k rows)."""
    return df.join(broadcast_if_small(ranked.select(cluster, F.col("label").alias(out))), cluster, "left")


def group_label_rate(df: DataFrame, group: str, label_col: str, label: str = "Low") -> DataFrame:
    """Percentage of rows in each group with the given label (e.g. % Low)."""
    d = df.where(F.col(group).isNotNull())
    return d.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        (100 * F.avg(F.coalesce((F.col(label_col) == F.lit(label)), F.lit(False)).cast("double"))).alias("pct_label"),
    )
