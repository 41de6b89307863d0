"""Numeric transforms.

Fitted statistics (means, stds, limits, skews, λ) are one-row aggregates
cross-joined (broadcast) back to the rows, so fit and apply stay one lazy plan;
``fit`` on a training frame and ``apply`` to any frame keeps the train-only
rule of the notebooks (quirk Q10: the test split uses the train limits).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import config
from cohortlens.functions.mathx import clip, logistic, sample_skewness
from cohortlens.operators.quantiles import order_statistics
from cohortlens.operators.sizing import one_row


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def standard_stats(df: DataFrame, cols: Sequence[str], ddof: int = 0) -> DataFrame:
    """T1 (fit): one row of mean and std per column (ddof 0 = sklearn's population std)."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    return df.agg(*[F.avg(_q(c)).alias(f"{c}__mean") for c in cols], *[std(_q(c)).alias(f"{c}__std") for c in cols])


def standardize(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None, ddof: int = 0) -> DataFrame:
    """``(x - mean) / std`` with statistics fitted on ``stats`` (default: df itself)."""
    st = one_row(stats if stats is not None else standard_stats(df, cols, ddof))
    j = df.crossJoin(st)
    return j.withColumns(
        {c: F.when(F.col(f"{c}__std") > 0, (_q(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std")).otherwise(F.lit(0.0)) for c in cols}
    ).drop(*st.columns)


def winsor_limits(df: DataFrame, col: str, lower: float = 0.005, upper: float = 0.005) -> DataFrame:
    """T2 (fit): the order statistics that bound the kept values: index
    ``floor(lower·n)`` from below and ``n - floor(upper·n) - 1`` (0-based, sorted)."""
    return order_statistics(
        df,
        col,
        {
            "lo": F.floor(F.col("_n") * F.lit(lower)).cast("long"),
            "hi": F.col("_n") - F.floor(F.col("_n") * F.lit(upper)).cast("long") - 1,
        },
    )


def winsorize(df: DataFrame, col: str, limits: DataFrame, out: str | None = None) -> DataFrame:
    """Clip to the limits fitted on the training split."""
    j = df.crossJoin(one_row(limits.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))))
    v = _q(col)
    return j.withColumn(out or col, F.when(v.isNotNull(), F.greatest(F.col("_lo"), F.least(F.col("_hi"), v)))).drop("_lo", "_hi")


def log_skewed(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None, threshold: float = 1.0) -> DataFrame:
    """``log1p`` on the columns whose |sample skew| (on ``fit``) exceeds
    the threshold; the choice is a one-row aggregate applied as ``when``."""
    src = fit if fit is not None else df
    sk = one_row(src.agg(*[sample_skewness(_q(c)).alias(f"{c}__skew") for c in cols]))
    j = df.crossJoin(sk)
    return j.withColumns(
        {c: F.when(F.abs(F.col(f"{c}__skew")) > threshold, F.log1p(_q(c))).otherwise(_q(c)) for c in cols}
    ).drop(*sk.columns)


def expm1_back(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """T3 inverse: ``expm1`` of columns on the log1p scale (predictions of a
    model fitted on a log1p target)."""
    return df.withColumns({c: F.expm1(_q(c)) for c in cols})


def yeo_johnson_expr(x: Column, lam: Column | float) -> Column:
    """T5: the Yeo-Johnson transform of x for λ (Column or constant)."""
    lam = F.lit(lam) if not isinstance(lam, Column) else lam
    pos = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    l2 = F.lit(2.0) - lam
    neg = F.when(F.abs(l2) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(-x + 1, l2) - 1) / l2)
    return F.when(x >= 0, pos).otherwise(neg)


def yeo_johnson_profile(df: DataFrame, col: str, grid: Sequence[float]) -> DataFrame:
    """T5 (fit): ``lambda, log_likelihood`` of every λ of the grid,
    ``-n/2 · log(var(y_λ)) + (λ - 1) · Σ sign(x) log1p(|x|)``, all from one aggregate
    pass over the non-null values (no rows without any)."""
    x = _q(col).cast("double")
    d = df.where(x.isNotNull())
    row = d.agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("_s"),
        F.array(*[F.var_pop(yeo_johnson_expr(x, float(lam))) for lam in grid]).alias("_v"),
    )
    each = row.where("_n > 0").select("_n", "_s", F.posexplode("_v").alias("_i", "_var"))
    lam = F.get(F.array(*[F.lit(float(v)) for v in grid]), F.col("_i"))
    return each.select(lam.alias("lambda"), (-F.col("_n") / 2 * F.log("_var") + (lam - 1) * F.col("_s")).alias("log_likelihood"))


#: The λ range searched first and its points, points of a refining pass, width of the final bracket, |λ| beyond which the search ends.
YJ_START, YJ_POINTS, YJ_REFINE, YJ_TOLERANCE, YJ_LIMIT = (-3.0, 3.0), 61, 41, 1e-6, 400.0


def _best_lambda(df: DataFrame, col: str, grid: Sequence[float]) -> tuple[int, float] | None:
    """Place and log-likelihood of the best λ of an ascending grid (one small row a
    point); overflow and constant results never win."""
    rows = sorted((r["lambda"], r["log_likelihood"]) for r in yeo_johnson_profile(df, col, grid).collect())
    good = [(ll, -i) for i, (_, ll) in enumerate(rows) if ll is not None and math.isfinite(ll)]
    if not good:
        return None
    ll, i = max(good)
    return -i, ll


def yeo_johnson_fit(df: DataFrame, col: str, grid: Sequence[float] | None = None) -> DataFrame:
    """T5 (fit): one row ``lambda, log_likelihood, at_edge``: the λ of the greatest
    likelihood.

    With a ``grid``, the best of its points.  Without one, the range is widened
    by further passes while the best λ lies at its edge (up to ``YJ_LIMIT``,
    flagged ``at_edge``), then the bracket around it is refined pass by pass down to
    ``YJ_TOLERANCE``.  A column without values, or a constant one, gets λ = 1 (the
    identity) and a null likelihood."""
    kind = "lambda double, log_likelihood double, at_edge boolean"
    spark = df.sparkSession
    points = sorted(map(float, grid)) if grid is not None else np.linspace(*YJ_START, YJ_POINTS).tolist()
    found = _best_lambda(df, col, points)
    if found is None:
        return spark.createDataFrame([(1.0, None, False)], kind)
    i, ll = found
    if grid is not None:
        return spark.createDataFrame([(points[i], ll, i in (0, len(points) - 1))], kind)
    while i in (0, len(points) - 1) and abs(points[i]) < YJ_LIMIT:
        edge, width = points[i], points[-1] - points[0]
        ends = (edge - 2 * width, edge + width / YJ_POINTS) if i == 0 else (edge - width / YJ_POINTS, edge + 2 * width)
        points = np.linspace(*ends, YJ_POINTS).tolist()
        i, ll = _best_lambda(df, col, points)
    at_edge = i in (0, len(points) - 1)
    while not at_edge and points[i + 1] - points[i - 1] > YJ_TOLERANCE:
        points = np.linspace(points[i - 1], points[i + 1], YJ_REFINE).tolist()
        i, ll = _best_lambda(df, col, points)
        i = min(max(i, 1), len(points) - 2)  # flat to the last digit: any neighbour will do
    return spark.createDataFrame([(float(points[i]), ll, at_edge)], kind)


def yeo_johnson(df: DataFrame, col: str, lam: DataFrame | float, out: str | None = None, standardize_out: bool = False) -> DataFrame:
    """T5: transform with a fitted (one-row frame) or fixed λ; optionally standardised."""
    if isinstance(lam, DataFrame):
        j = df.crossJoin(one_row(lam.select(F.col("lambda").alias("_lam"))))
        res = j.withColumn(out or col, yeo_johnson_expr(_q(col).cast("double"), F.col("_lam"))).drop("_lam")
    else:
        res = df.withColumn(out or col, yeo_johnson_expr(_q(col).cast("double"), float(lam)))
    return standardize(res, [out or col]) if standardize_out else res


def minmax_scale(df: DataFrame, col: str, out: str | None = None, lo: float = 0.0, hi: float = 100.0, fit: DataFrame | None = None) -> DataFrame:
    """``lo + (hi - lo) · (x - min) / (max - min)`` with min / max fitted on
    ``fit`` (default df); persisting the fit avoids the one-row min = max trap (Q5)."""
    src = fit if fit is not None else df
    mm = one_row(src.agg(F.min(_q(col)).alias("_mn"), F.max(_q(col)).alias("_mx")))
    j = df.crossJoin(mm)
    scaled = F.lit(lo) + F.lit(hi - lo) * (_q(col) - F.col("_mn")) / F.nullif(F.col("_mx") - F.col("_mn"), F.lit(0.0))
    return j.withColumn(out or col, scaled).drop("_mn", "_mx")


def fallback_score(
    cols: Mapping[str, str],
    short: bool = False,
    defaults: Mapping[str, float] | None = None,
) -> tuple[Column, Column]:
    """The dashboards' weighted linear score (clipped 0-100) and its
    logistic risk.  ``cols`` maps the roles ``attendance, homework,
    participation, resources, textbook, ratio`` to column names; a missing
    value takes the serving default.  ``short`` is the form with only the
    resources, engagement, textbook and attendance terms (quirk Q15)."""
    d = {
        "attendance": config.DEFAULT_FILLS["Overall_Avg_Attendance"],
        "homework": config.DEFAULT_FILLS["Overall_Avg_Homework"],
        "participation": config.DEFAULT_FILLS["Overall_Avg_Participation"],
        "resources": config.DEFAULT_FILLS["School_Resources_Score"],
        "textbook": config.DEFAULT_FILLS["Overall_Textbook_Access_Composite"],
        "ratio": config.DEFAULT_FILLS["Teacher_Student_Ratio"],
        **(defaults or {}),
    }
    v = {k: F.coalesce(_q(cols[k]).cast("double"), F.lit(float(d[k]))) if k in cols else F.lit(float(d[k])) for k in d}
    w = config.FALLBACK_WEIGHTS
    eng = (v["attendance"] * config.ENGAGEMENT_WEIGHTS[0] + v["homework"] * config.ENGAGEMENT_WEIGHTS[1]
           + v["participation"] * config.ENGAGEMENT_WEIGHTS[2]) / 100
    s = (F.lit(w["resources"]) * v["resources"] + F.lit(w["engagement"]) * eng + F.lit(w["textbook"]) * v["textbook"]
         + F.lit(w["attendance"]) * v["attendance"] / 100)
    if not short:
        s = s + F.lit(w["ratio"]) * v["ratio"] / 100 + F.lit(w["homework"]) * v["homework"] / 100 \
            + F.lit(w["participation"]) * v["participation"] / 100
    score = clip(s * F.lit(config.FALLBACK_SCALE) + F.lit(config.FALLBACK_OFFSET), 0.0, 100.0)
    return score, logistic(score)


def align_features(df: DataFrame, order: Sequence[str], fill: Mapping[str, object] | DataFrame | None = None,
                   keep: Sequence[str] = ()) -> DataFrame:
    """Select ``keep`` + ``order``; absent features are added from ``fill``
    (a dict of constants, or a one-row frame of training medians), extras dropped."""
    have = set(df.columns)
    missing = [c for c in order if c not in have]
    out = df
    if missing and isinstance(fill, DataFrame):
        out = out.crossJoin(one_row(fill.select(*[F.col(c) for c in missing if c in fill.columns])))
    elif missing:
        out = out.withColumns({c: F.lit((fill or {}).get(c)).cast("double") for c in missing})
    return out.select(*keep, *[F.col(f"`{c}`").cast("double").alias(c) if c in missing else _q(c) for c in order])
