"""Aggregate reports.

Each report is one ``groupBy``/global ``agg`` with conditional aggregation, not
a filtered scan per category: one pass over the input, partial aggregation on
the map side, a shuffle of at most (#groups × #tasks) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import config
from cohortlens.functions.categorize import level_band
from cohortlens.operators.quantiles import quantiles
from cohortlens.operators.sizing import one_row


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def group_stats(df: DataFrame, keys: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """A1: mean, count (non-null) and sample std of ``value`` per key set; null keys dropped."""
    d = df
    for k in keys:
        d = d.where(F.col(k).isNotNull())
    return d.groupBy(*keys).agg(
        F.avg(value).alias(f"{prefix}avg"),
        F.count(value).alias(f"{prefix}count"),
        F.stddev_samp(value).alias(f"{prefix}std"),
    )


def per_key_mean(df: DataFrame, key: str, value: str, out: str = "mean_value") -> DataFrame:
    """A2."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias(out))


def grouping_summaries(df: DataFrame, dims: Sequence[str], id_col: str, value: str) -> DataFrame:
    """A3: count of ids and mean value per member of each dimension, all
    dimensions in one pass with GROUPING SETS.  Long output
    ``(dimension, member, n, mean_value)``; null members dropped."""
    g = df.groupingSets([[d] for d in dims], *dims).agg(
        F.count(id_col).alias("n"),
        F.avg(value).alias("mean_value"),
        *[F.grouping(d).alias(f"_g_{d}") for d in dims],
    )
    dim_expr = None
    member = None
    for d in dims:
        is_d = F.col(f"_g_{d}") == 0
        dim_expr = F.when(is_d, F.lit(d)) if dim_expr is None else dim_expr.when(is_d, F.lit(d))
        member = F.when(is_d, F.col(d).cast("string")) if member is None else member.when(is_d, F.col(d).cast("string"))
    return g.select(dim_expr.alias("dimension"), member.alias("member"), "n", "mean_value").where(
        F.col("member").isNotNull()
    )


def group_count_mean(df: DataFrame, key: str, value: str, id_col: str | None = None) -> DataFrame:
    """A4 / A5: rows (or ids) and mean per key, null key dropped."""
    n = F.count(id_col) if id_col else F.count(F.lit(1))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(n.alias("n"), F.avg(value).alias("mean_value"))


def value_counts(df: DataFrame, key: str, normalize: bool = False) -> DataFrame:
    """Count per value (null dropped) and its share of all non-null rows."""
    vc = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if normalize:
        total = vc.agg(F.sum("n").alias("_total"))
        vc = vc.crossJoin(one_row(total)).withColumn("share", F.col("n") / F.col("_total")).drop("_total")
    return vc


def kpi_overview(df: DataFrame, value: str, pass_mark: float = config.PASS_MARK, risk_mark: float = config.RISK_MARK) -> DataFrame:
    """One-row KPIs.  Pass / risk rates have every row in the denominator
    (a null value is neither passing nor at risk).  The median is the exact
    distributed quantile (no buffer of all distinct values in one task)."""
    v = F.col(value)
    med = quantiles(df, value, [0.5], names=["median"])
    agg = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        (100 * F.avg(F.coalesce(v >= pass_mark, F.lit(False)).cast("int"))).alias("pass_rate"),
        F.count_if(v < risk_mark).alias("risk_count"),
        (100 * F.avg(F.coalesce(v < risk_mark, F.lit(False)).cast("int"))).alias("risk_rate"),
    )
    j = agg.crossJoin(med)
    return j.select("total", "mean", "median", "std", "min", "max", "pass_rate", "risk_count", "risk_rate")


def band_report(df: DataFrame, value: str, extra_means: Sequence[str] = (), bands=config.LEVEL_BANDS) -> DataFrame:
    """Per performance band (< 50 Low, < 70 Medium, else High): count, % of
    all rows, mean value and the mean of each extra column; one groupBy."""
    from pyspark.sql import Window

    b = df.withColumn("band", level_band(value, bands)).where(F.col("band").isNotNull())
    out = b.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean_value"),
        *[F.avg(c).alias(f"mean_{c}") for c in extra_means],
    )
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return out.crossJoin(F.broadcast(total)).withColumn("pct", 100 * F.col("n") / F.col("_total")).drop("_total")


def threshold_split(df: DataFrame, value: str, mark: float) -> DataFrame:
    """Pass (>= mark) / fail (< mark) count, % of all rows and mean, one pass."""
    v = F.col(value)
    agg = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(v >= mark).alias("n_pass"),
        F.count_if(v < mark).alias("n_fail"),
        F.avg(F.when(v >= mark, v)).alias("mean_pass"),
        F.avg(F.when(v < mark, v)).alias("mean_fail"),
    )
    return agg.select(
        "total",
        "n_pass",
        "n_fail",
        (100 * F.col("n_pass") / F.col("total")).alias("pct_pass"),
        (100 * F.col("n_fail") / F.col("total")).alias("pct_fail"),
        "mean_pass",
        "mean_fail",
    )


def threshold_group_table(df: DataFrame, key: str, value: str, mark: float) -> DataFrame:
    """Per group: rows, high (>= mark), low (< mark), high %, mean, min, max;
    sorted by mean descending.  Null groups dropped."""
    v = F.col(value)
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(v >= mark).alias("n_high"),
        F.count_if(v < mark).alias("n_low"),
        F.avg(v).alias("mean_value"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
    )
    return g.withColumn("pct_high", 100 * F.col("n_high") / F.col("total")).orderBy(F.desc("mean_value"), key)


def track_report(df: DataFrame, tracks: dict[str, Sequence[str]]) -> DataFrame:
    """Per track the mean of its subject means (mean-of-means, unweighted),
    plus one row per subject; one global aggregate, then unpivoted."""
    subjects = sorted({s for subs in tracks.values() for s in subs})
    row = df.agg(*[F.avg(s).alias(s) for s in subjects])
    per_subject = row.unpivot([], subjects, "subject", "mean_value")
    parts = [
        row.select(
            F.lit(t).alias("track"),
            F.lit(None).cast("string").alias("subject"),
            (sum((F.col(s) for s in subs), F.lit(0.0)) / len(subs)).alias("mean_value"),
        )
        for t, subs in tracks.items()
    ]
    subject_track = None
    for t, subs in tracks.items():
        cond = F.col("subject").isin(*subs)
        subject_track = F.when(cond, F.lit(t)) if subject_track is None else subject_track.when(cond, F.lit(t))
    subj_rows = per_subject.select(subject_track.alias("track"), "subject", "mean_value")
    out = subj_rows
    for p in parts:
        out = out.unionByName(p)
    return out


def quick_summary(df: DataFrame, value: str) -> DataFrame:
    """KPIs and band counts/percentages in one row (exact distributed median)."""
    v = F.col(value)
    med = quantiles(df, value, [0.5], names=["median"])
    agg = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.avg(v).alias("mean"),
        F.count_if(v < 50).alias("n_low"),
        F.count_if((v >= 50) & (v < 70)).alias("n_medium"),
        F.count_if(v >= 70).alias("n_high"),
    )
    agg = agg.crossJoin(med)
    return agg.select(
        "total", "mean", "median", "n_low", "n_medium", "n_high",
        *[(100 * F.col(c) / F.col("total")).alias(f"pct_{c[2:]}") for c in ("n_low", "n_medium", "n_high")],
    )


def quality_report(metrics: Sequence[tuple[str, DataFrame, Column]]) -> DataFrame:
    """A10: ``(Metric, Value)`` rows, each a one-row aggregate of its own table,
    unioned (each part is a global aggregate; the union has len(metrics) rows)."""
    out = None
    for name, frame, expr in metrics:
        part = frame.agg(expr.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def exec_summary(df: DataFrame, key: str, risk_col: str, value: str) -> DataFrame:
    """Dataset size, mean, and the groups with the highest / lowest risk
    share (``max_by`` / ``min_by`` over the per-group table)."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.avg(F.col(risk_col).cast("double")).alias("risk_share"), F.count(F.lit(1)).alias("n")
    )
    pick = per.agg(
        F.max_by(F.col(key), F.struct(F.col("risk_share"), F.col(key))).alias("top_group"),
        F.max(F.col("risk_share")).alias("top_share"),
        F.min_by(F.col(key), F.struct(F.col("risk_share"), F.col(key))).alias("bottom_group"),
        F.min(F.col("risk_share")).alias("bottom_share"),
        F.count(F.lit(1)).alias("n_groups"),
    )
    size = df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(value).alias("mean_value"))
    wide = size.crossJoin(pick)
    return wide.select(
        F.explode(
            F.array(
                F.struct(F.lit("rows").alias("metric"), F.col("n_rows").cast("double").alias("value"), F.lit(None).cast("string").alias("details")),
                F.struct(F.lit("mean_value").alias("metric"), F.col("mean_value").alias("value"), F.lit(None).cast("string").alias("details")),
                F.struct(F.lit("groups").alias("metric"), F.col("n_groups").cast("double").alias("value"), F.lit(None).cast("string").alias("details")),
                F.struct(F.lit("highest_risk").alias("metric"), (100 * F.col("top_share")).alias("value"), F.col("top_group").cast("string").alias("details")),
                F.struct(F.lit("lowest_risk").alias("metric"), (100 * F.col("bottom_share")).alias("value"), F.col("bottom_group").cast("string").alias("details")),
            )
        ).alias("r")
    ).select("r.*")


def summary_table(
    scores: DataFrame, value: str, mark: float, clusters: DataFrame, models: DataFrame, classifiers: DataFrame, risks: DataFrame, group: str
) -> DataFrame:
    """``section, metric, value, share, name`` from the stored results of
    other steps: the scored rows; ``clusters`` (label, n); ``models`` (model, r2,
    mae); ``classifiers`` (model, f1, auc); ``risks`` (the group, pct_label).

    Each part is an aggregate of one row (the result tables have a row a cluster,
    model or group), so the table costs a pass over the scored rows and no more.
    The best model is the one of the highest r2 (f1), the first by name among
    equals; a part without rows gives null values."""

    def cell(section: str, metric: str, val: Column, share: Column | None = None, name: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(
            F.lit(section).alias("section"),
            F.lit(metric).alias("metric"),
            val.cast("double").alias("value"),
            (none if share is None else share).cast("double").alias("share"),
            (none if name is None else name).cast("string").alias("name"),
        )

    rows, low = F.count(F.lit(1)), F.count_if(F.col(value) < mark)
    parts = [
        scores.agg(
            F.array(
                cell("dataset", "rows", rows, F.lit(100.0)),
                cell("dataset", "at_risk", low, 100 * low / rows),
                cell("dataset", "mean_value", F.avg(value)),
            ).alias("c")
        )
    ]
    total = F.sum("n")
    sized = [(x, F.coalesce(F.sum(F.when(F.col("label") == x, F.col("n"))), F.lit(0))) for x in ("High", "Medium", "Low")]
    parts.append(clusters.agg(F.array(*[cell("clusters", x.lower(), n, 100 * n / total) for x, n in sized]).alias("c")))

    def best(by: str, what: str) -> Column:
        # the first name among equals: the greatest value, then the least name
        found = F.collect_list(F.struct((-F.col(by)).alias("k"), F.col("model").alias("m"), F.col(what).cast("double").alias("v")))
        return F.get(F.sort_array(found), F.lit(0))

    parts.append(
        models.agg(
            F.array(
                cell("models", "best_r2", best("r2", "r2")["v"], name=best("r2", "r2")["m"]),
                cell("models", "best_mae", best("r2", "mae")["v"], name=best("r2", "mae")["m"]),
            ).alias("c")
        )
    )
    parts.append(
        classifiers.agg(
            F.array(
                cell("classifiers", "best_f1", best("f1", "f1")["v"], name=best("f1", "f1")["m"]),
                cell("classifiers", "best_auc", best("f1", "auc")["v"], name=best("f1", "auc")["m"]),
            ).alias("c")
        )
    )
    by = F.struct(F.col("pct_label"), F.col(group))
    parts.append(
        risks.where(F.col(group).isNotNull()).agg(
            F.array(
                cell("risk", "highest", F.max("pct_label"), name=F.max_by(F.col(group), by)),
                cell("risk", "lowest", F.min("pct_label"), name=F.min_by(F.col(group), by)),
            ).alias("c")
        )
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.explode("c").alias("r")).select("r.*")
