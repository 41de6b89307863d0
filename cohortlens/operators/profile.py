"""Data profiles and quality checks.

Per-column statistics over many columns are computed in *long* form: one
``unpivot`` to ``(column, value)`` and a ``groupBy(column)``, so the plan has one
aggregate regardless of the width, distinct counts are exact without a per-column
Expand, and a column is a group, not a separate scan.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.mathx import sample_skewness
from cohortlens.operators.quantiles import quantiles
from cohortlens.operators.sizing import broadcast_if_small, one_row
from cohortlens.session import materialize


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    """S2 (schema part): raise listing every missing column."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def validate_input(df: DataFrame, key: str, target: str, required: Sequence[str] = ()) -> DataFrame:
    """Schema check, then one aggregate: rows, null keys, duplicate keys, null targets."""
    require_columns(df, [key, target, *required])
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(_q(key).isNull()).alias("n_null_keys"),
        (F.count(_q(key)) - F.count_distinct(_q(key))).alias("n_duplicate_keys"),
        F.count_if(_q(target).isNull()).alias("n_null_target"),
    )


def to_long(df: DataFrame, columns: Sequence[str], as_type: str = "double") -> DataFrame:
    """``(column, value)`` rows of the given columns (one Expand)."""
    return df.select(*[_q(c).cast(as_type).alias(c) for c in columns]).unpivot([], list(columns), "column", "value")


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and % per column."""
    cols = list(columns or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(_q(c).isNull()).alias(c) for c in cols])
    long = row.unpivot(["_n"], cols, "column", "n_null")
    return long.select("column", "n_null", (100 * F.col("n_null") / F.col("_n")).alias("pct_null"))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A20 (values): every distinct value (as text, null included) of each column
    with its row count -- the complete table, no cap."""
    long = to_long(df, columns, "string")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def cardinality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per column counting null as a value (``nunique``
    with NaN included), and without it.

    Only hashes are grouped: a value's text never leaves its task.  Two values
    of one 64-bit hash show by a second one; where that happens the texts of
    just these hashes are counted."""
    cols = list(columns)
    text = [_q(c).cast("string") for c in cols]
    pair = [F.struct(F.lit(c).alias("column"), F.when(t.isNotNull(), F.xxhash64(t)).alias("h"), F.xxhash64(F.lit(1), t).alias("h2")) for c, t in zip(cols, text, strict=True)]
    hashed = df.select(F.explode(F.array(*pair)).alias("p")).select("p.*")
    per_hash = hashed.groupBy("column", "h").agg(F.min("h2").alias("a"), F.max("h2").alias("b"))
    shared = F.col("h").isNotNull() & (F.col("a") != F.col("b"))
    counts = materialize(
        per_hash.groupBy("column").agg(
            F.count(F.lit(1)).alias("n_unique_with_null"), F.count("h").alias("n_unique"), F.count_if(shared).alias("shared")
        )
    )
    if counts.where("shared > 0").limit(1).count():
        which = per_hash.where(shared).select("column", "h")
        texts = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), t.alias("v")) for c, t in zip(cols, text, strict=True)])).alias("p")).select("p.*")
        again = texts.where("v IS NOT NULL").withColumn("h", F.xxhash64("v")).join(which, ["column", "h"], "left_semi")
        more = again.distinct().groupBy("column").agg((F.count(F.lit(1)) - F.countDistinct("h")).alias("more"))
        counts = counts.join(F.broadcast(more), "column", "left")  # a row a column
        extra = F.coalesce("more", F.lit(0))
        counts = counts.withColumns({c: F.col(c) + extra for c in ("n_unique_with_null", "n_unique")})
    return counts.select("column", "n_unique_with_null", "n_unique")


def dtype_profile(df: DataFrame) -> DataFrame:
    """Per Spark type: number of columns, mean null % and largest cardinality."""
    types = dict(df.dtypes)
    nulls = null_profile(df)
    card = cardinality(df, df.columns)
    kinds = df.sparkSession.createDataFrame([(c, t) for c, t in types.items()], "column string, dtype string")
    per_col = one_row_safe_join(nulls.join(card, "column"), kinds)
    return per_col.groupBy("dtype").agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.avg("pct_null").alias("mean_pct_null"),
        F.max("n_unique").alias("max_unique"),
    )


def one_row_safe_join(a: DataFrame, names: DataFrame) -> DataFrame:
    """Join a per-column table to the schema table (one row per column: bounded
    by the schema width) by broadcast."""
    return a.join(F.broadcast(names), "column")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, 25/50/75 % (exact, interpolated), max per column."""
    long = to_long(df, columns).where(F.col("value").isNotNull())
    moments = {"count": F.count("_v"), "mean": F.avg("_v"), "std": F.stddev_samp("_v"), "min": F.min("_v"), "max": F.max("_v")}
    qs = quantiles(long, "value", [0.25, 0.5, 0.75], ["column"], ["q25", "q50", "q75"], extra=moments)
    return qs.select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def scale_check(df: DataFrame, columns: Sequence[str], lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Min, max, mean, out-of-range count and the inferred scale (max <= 1 -> 0-1)."""
    long = to_long(df, columns)
    g = long.groupBy("column").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.count_if((F.col("value") < lo) | (F.col("value") > hi)).alias("n_out_of_range"),
    )
    return g.withColumn("scale", F.when(F.col("max") <= 1, "0-1").otherwise("0-100"))


def skewness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bias-adjusted sample skewness per column (pandas ``skew``)."""
    long = to_long(df, columns)
    return long.groupBy("column").agg(sample_skewness("value").alias("skew"))


def iqr_outliers(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """q1, q3 and the count of values outside ``[q1 - k IQR, q3 + k IQR]``."""
    long = to_long(df, columns).where(F.col("value").isNotNull())
    qs = quantiles(long, "value", [0.25, 0.75], ["column"], ["q1", "q3"])
    j = long.join(F.broadcast(qs), "column")  # one row per column: bounded by the schema
    iqr = F.col("q3") - F.col("q1")
    out = (F.col("value") < F.col("q1") - k * iqr) | (F.col("value") > F.col("q3") + k * iqr)
    return j.groupBy("column", "q1", "q3").agg(F.count_if(out).alias("n_outliers"))


def histogram(df: DataFrame, value: str, bins: int, groups: Sequence[str] = ()) -> DataFrame:
    """``bins`` equal-width bins between the global min and max (numpy
    semantics: right edge of the last bin is closed), per group if given.
    Empty bins are not emitted."""
    d = df.where(_q(value).isNotNull())
    mm = one_row(d.agg(F.min(value).alias("_min"), F.max(value).alias("_max")))
    j = d.crossJoin(mm)
    width = (F.col("_max") - F.col("_min")) / bins
    b = F.when(F.col("_max") == F.col("_min"), F.lit(0)).otherwise(
        F.least(F.floor((_q(value) - F.col("_min")) / width).cast("int"), F.lit(bins - 1))
    )
    j = j.withColumn("bin", b)
    g = j.groupBy(*groups, "bin", "_min", "_max").agg(F.count(F.lit(1)).alias("n"))
    return g.select(
        *groups,
        "bin",
        (F.col("_min") + F.col("bin") * width).alias("lo"),
        (F.col("_min") + (F.col("bin") + 1) * width).alias("hi"),
        "n",
    )


def density_by_group(df: DataFrame, value: str, group: str, bins: int) -> DataFrame:
    """Per group, histogram normalised to a density (n / (group n * width))."""
    h = histogram(df.where(F.col(group).isNotNull()), value, bins, [group])
    tot = h.groupBy(group).agg(F.sum("n").alias("_gn"))
    j = h.join(tot, group)
    return j.select(group, "bin", "lo", "hi", "n", (F.col("n") / (F.col("_gn") * (F.col("hi") - F.col("lo")))).alias("density"))


#: Fixed values of the density curve: points, reach beyond the data in bandwidths, cells a group's values are binned to.
CURVE_POINTS, CURVE_CUT, CURVE_CELLS = 200, 3.0, 1024


def density_curve(df: DataFrame, value: str, group: str, points: int = CURVE_POINTS, cells: int = CURVE_CELLS) -> DataFrame:
    """Per group a Gaussian kernel density on ``points`` even steps from
    ``CURVE_CUT`` bandwidths below the least value to as many above the greatest,
    with Scott's bandwidth ``std · n^(-1/5)``: ``group, point, x, density``.

    The kernel is laid over a fine histogram (a cell stands at the mean of its
    values), so the work after one aggregate is groups × cells × points whatever
    the number of rows.  Groups whose values are all equal have no curve."""
    v = _q(value).cast("double")
    d = df.where(F.col(group).isNotNull() & v.isNotNull() & ~F.isnan(v)).select(group, v.alias("_v"))
    per = d.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.stddev_samp("_v").alias("_sd")
    )
    per = materialize(per.where("_sd > 0").withColumn("_bw", F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2))))
    placed = d.join(broadcast_if_small(per), group)
    cell = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cells), F.lit(cells - 1)).alias("_cell")
    binned = placed.groupBy(group, cell).agg(F.count(F.lit(1)).alias("_c"), F.avg("_v").alias("_at"))
    start, end = F.col("_lo") - CURVE_CUT * F.col("_bw"), F.col("_hi") + CURVE_CUT * F.col("_bw")
    each = binned.join(broadcast_if_small(per), group).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    each = each.withColumn("x", start + F.col("point") * (end - start) / (points - 1))
    z = (F.col("x") - F.col("_at")) / F.col("_bw")
    kernel = F.col("_c") * F.exp(-z * z / 2) / (F.col("_n") * F.col("_bw") * math.sqrt(2 * math.pi))
    return each.groupBy(group, "point", "x").agg(F.sum(kernel).alias("density"))


def box_stats(df: DataFrame, value: str, group: str, k: float = 1.5) -> DataFrame:
    """Per group quartiles, IQR whiskers (most extreme values inside
    ``[q1 - k IQR, q3 + k IQR]``), mean, sample std, outlier count."""
    d = df.where(F.col(group).isNotNull() & _q(value).isNotNull()).select(group, _q(value).cast("double").alias("v"))
    qs = quantiles(d, "v", [0.25, 0.5, 0.75], [group], ["q1", "median", "q3"])
    j = d.join(broadcast_if_small(qs), group)  # one row per group; AQE splits a hot one otherwise
    iqr = F.col("q3") - F.col("q1")
    lo_f = F.col("q1") - k * iqr
    hi_f = F.col("q3") + k * iqr
    return j.groupBy(group, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min(F.when(F.col("v") >= lo_f, F.col("v"))).alias("whisker_lo"),
        F.max(F.when(F.col("v") <= hi_f, F.col("v"))).alias("whisker_hi"),
        F.count_if((F.col("v") < lo_f) | (F.col("v") > hi_f)).alias("n_outliers"),
    )


def coverage_by_grade(long: DataFrame, id_col: str, grade: str = "Grade_Level", metric: str = "Metric", subject: str = "Subject", value: str = "Value") -> DataFrame:
    """A19 (on data): per grade and metric: distinct subjects, values, distinct ids."""
    return long.groupBy(grade, metric).agg(
        F.count_distinct(subject).alias("n_subjects"),
        F.count(value).alias("n_values"),
        F.count_distinct(id_col).alias("n_ids"),
    )


def feature_coverage(df: DataFrame, features: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """A28 (on data): ``features`` maps a required feature to (category, aliases);
    the first alias present in the schema is used (coalesced when several are),
    the non-null rate of each feature is taken in one aggregate, then rolled up
    per category.  A feature with no alias present has rate 0."""
    exprs = {}
    cats = {}
    for name, (category, aliases) in features.items():
        present = [a for a in aliases if a in df.columns]
        e = F.coalesce(*[_q(a) for a in present]) if present else F.lit(None)
        exprs[name] = F.avg(e.isNotNull().cast("double"))
        cats[name] = category
    row = df.agg(*[v.alias(k) for k, v in exprs.items()])
    long = row.unpivot([], list(exprs), "feature", "non_null_rate")
    kinds = df.sparkSession.createDataFrame(list(cats.items()), "feature string, category string")
    j = long.join(F.broadcast(kinds), "feature")
    return j.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.avg("non_null_rate").alias("mean_non_null_rate"),
        F.min("non_null_rate").alias("min_non_null_rate"),
        F.count_if(F.col("non_null_rate") > 0).alias("n_available"),
    )
