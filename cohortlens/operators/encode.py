"""Categorical encoders.

Encoders are small DataFrames keyed by category (one row per category, or per
category and fold) joined back to the rows; the join side is broadcast only when
its estimated size is small, otherwise it is a regular shuffle join.  Constant
maps are literal ``map`` lookups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import config
from cohortlens.functions.categorize import lookup, title_case
from cohortlens.operators.sizing import broadcast_if_small, one_row
from cohortlens.sources.prepare import row_positions


def map_encode(df: DataFrame, maps: Mapping[str, Mapping], suffix: str = "", defaults: Mapping[str, object] | None = None) -> DataFrame:
    """``Series.map(dict)`` per column (unmapped -> null, or the default)."""
    defaults = defaults or {}
    return df.withColumns(
        {f"{c}{suffix}": lookup(c, m, defaults.get(c)) for c, m in maps.items() if c in df.columns}
    )


def health_encode(df: DataFrame, col: str, severity: Mapping[str, int] = config.HEALTH_SEVERITY,
                  healthy: str = "No Issue", default: int = config.HEALTH_DEFAULT_SEVERITY) -> DataFrame:
    """Trim + title-case, then flag (0 when healthy) and severity (unmapped -> default)."""
    t = title_case(col)
    return df.withColumns(
        {
            f"{col}_Flag": F.when(t == F.lit(healthy), F.lit(0)).otherwise(F.lit(1)),
            f"{col}_Severity": lookup(t, severity, default).cast("int"),
        }
    )


def frequency_table(df: DataFrame, col: str) -> DataFrame:
    """E5 (fit): share of each non-null category among non-null rows."""
    vc = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    tot = one_row(vc.agg(F.sum("_n").alias("_t")))
    return vc.crossJoin(tot).select(col, (F.col("_n") / F.col("_t")).alias("freq"))


def frequency_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """E5: category -> its frequency share (unseen/null -> null)."""
    t = frequency_table(df, col).withColumnRenamed("freq", out or f"{col}_Freq")
    return df.join(broadcast_if_small(t), col, "left")


def target_encoder(df: DataFrame, col: str, target: str, alpha: float = config.SMOOTHING_ALPHA) -> DataFrame:
    """E6 (fit): ``(category, n, mean, encoding, global_mean)`` with
    ``encoding = (n·mean + α·global) / (n + α)``; the global mean is over all
    rows with a target."""
    d = df.where(F.col(target).isNotNull())
    g = one_row(d.agg(F.avg(target).alias("global_mean")))
    s = d.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean"))
    s = s.crossJoin(g)
    enc = (F.col("n") * F.col("mean") + F.lit(alpha) * F.col("global_mean")) / (F.col("n") + F.lit(alpha))
    return s.select(col, "n", "mean", enc.alias("encoding"), "global_mean")


def apply_encoder(df: DataFrame, encoder: DataFrame, col: str, out: str) -> DataFrame:
    """Join the encoder table; unseen or null category -> the encoder's global mean."""
    g = one_row(encoder.agg(F.first("global_mean").alias("_g")))
    e = encoder.select(col, F.col("encoding").alias("_enc"))
    j = df.join(broadcast_if_small(e), col, "left").crossJoin(g)
    return j.withColumn(out, F.coalesce(F.col("_enc"), F.col("_g"))).drop("_enc", "_g")


def save_encoder(encoder: DataFrame, path: str) -> None:
    encoder.write.mode("overwrite").parquet(path)


def load_encoder(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def kfold_target_encode(
    df: DataFrame,
    col: str | Sequence[str],
    target: str,
    fold: Column,
    out: str | Sequence[str],
    alpha: float = config.SMOOTHING_ALPHA,
) -> DataFrame:
    """Out-of-fold smoothed target encoding of one or several columns.

    Per column, the rows are aggregated once by (category, fold) -- every pair
    present in the data, with the sum and count of non-null targets -- and a
    window partitioned by category (at most k rows per category) adds the
    category totals; ``total - own fold`` gives the out-of-fold statistics.
    The smoothing prior is the global mean over *all* rows (one more
    aggregate).  A category absent from the other folds, or a null category,
    gets the global mean.  The encoder tables (#categories × k rows each) are
    joined onto the input once, so the input is scanned once per column for
    its aggregate, once for the prior and once for the output -- encodings of
    several columns do not stack each other's plans."""
    from pyspark.sql import Window

    cols = [col] if isinstance(col, str) else list(col)
    outs = [out] if isinstance(out, str) else list(out)
    d = df.withColumn("_fold", fold)
    y = F.col(target).cast("double")
    g = one_row(d.agg(F.avg(y).alias("_g")))
    res = d
    for c, o in zip(cols, outs):
        per = d.where(F.col(c).isNotNull()).groupBy(c, "_fold").agg(F.sum(y).alias("_fs"), F.count(y).alias("_fc"))
        w = Window.partitionBy(c)
        per = per.withColumn("_ts", F.sum("_fs").over(w)).withColumn("_tc", F.sum("_fc").over(w))
        oof_n = F.col("_tc") - F.col("_fc")
        oof_s = F.coalesce(F.col("_ts"), F.lit(0.0)) - F.coalesce(F.col("_fs"), F.lit(0.0))
        enc = per.crossJoin(g).select(
            c,
            "_fold",
            F.coalesce(F.when(oof_n > 0, (oof_s + F.lit(alpha) * F.col("_g")) / (oof_n + F.lit(alpha))), F.col("_g")).alias(o),
        )
        res = res.join(broadcast_if_small(enc), [c, "_fold"], "left")
    res = res.crossJoin(g)
    return res.withColumns({o: F.coalesce(F.col(o), F.col("_g")) for o in outs}).drop("_g", "_fold")


def distinct_sorted(df: DataFrame, col: str, limit: int | None = None) -> list:
    """Sorted distinct non-null values (an action; used only for schema-shaping
    encoders on low-cardinality columns, with ``limit`` as the cardinality check)."""
    q = df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col)
    if limit is not None:
        q = q.limit(limit + 1)
    return [r[0] for r in q.collect()]


def one_hot(df: DataFrame, cols: Sequence[str], max_unique: int = config.ONE_HOT_MAX_UNIQUE, drop_first: bool = True) -> DataFrame:
    """One 0/1 column ``<col>_<value>`` per category, first (sorted) value
    dropped, only for columns with at most ``max_unique`` values (others are
    left as they are).  The values shape the schema, so they are read first."""
    out = df
    for c in cols:
        vals = distinct_sorted(df, c, max_unique)
        if len(vals) > max_unique:
            continue
        keep = vals[1:] if drop_first else vals
        out = out.withColumns({f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)) for v in keep}).drop(c)
    return out


def label_encoder(df: DataFrame, col: str) -> DataFrame:
    """E9 (fit): ``(category, index)`` with the index in sorted order from 0.
    Ranks are taken over the distinct values only."""
    vals = df.where(F.col(col).isNotNull()).select(col).distinct()
    return row_positions(vals, [col], "_pos").select(col, (F.col("_pos") - 1).cast("int").alias("index"))


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    t = label_encoder(df, col).withColumnRenamed("index", out or f"{col}_Label")
    return df.join(broadcast_if_small(t), col, "left")
